import random

from tessera.llm.quality import score_documents, with_verdict


def tables(spark, n=400):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(draw.randint(20, 60))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["zzvile", "zzmean"]))
        docs.append((i, " ".join(words), f"s{i % 3}", "en"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    found = with_verdict(score_documents(docs, labels.where("doc_id % 3 <> 0"))).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = lambda score, truth: sum((r[score] >= 0.5) == bool(r[truth]) for r in found) / len(found)
    assert right("quality_score", "quality") > 0.95 and right("toxic_score", "toxic") > 0.9
    assert all(r.kept == (r.quality_score >= 0.5 and r.toxic_score < 0.5) for r in found)


def test_nulls_empty_tables_and_clashing_names(spark):
    docs, labels = tables(spark)
    odd = spark.createDataFrame([(None, None, None, None, "c"), (7, "", "s", "en", "c"), (7, "x " * 50_000, "s", None, "c")], "doc_id long, text string, source string, lang string, content string")
    assert score_documents(odd, labels).count() == 3
    assert score_documents(docs.limit(0), labels).count() == 0
    unlabelled = with_verdict(score_documents(docs, labels.limit(0))).collect()
    assert len(unlabelled) == 400 and all(r.quality_score is None and r.kept for r in unlabelled)

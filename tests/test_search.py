"""Search by blocks against plain loops."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import postings as P
from tessera.operators import search as S


def plain_counts(text, term):
    words, parts = (text or "").split(), term.split(" ")
    return sum(words[i : i + len(parts)] == parts for i in range(len(words)))


def test_best_scores_by_blocks(spark):
    """Several blocks, parts of the questions and passes over the terms; equal texts tie and go by id."""
    draw = random.Random(4)
    docs = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.choice([0, 1, 5, 40])))) for i in range(300)]
    docs += [(1000 + i, t) for i, t in docs[:150]] + [(2000, None)]
    terms = sorted({(q, draw.choice(["a", "b", "c", "h", "a b", "c c", "b a c", "zz", "a zz"])) for q in range(12) for _ in range(4)})
    df = spark.createDataFrame(docs, "id long, content string").repartition(7)
    asked = spark.createDataFrame(terms, "question long, term string").repartition(3)
    n, mean = len(docs), sum(len((t or "").split()) for _, t in docs) / len(docs)
    tf = {(i, t): plain_counts(text, t) for i, text in docs for _, t in terms}
    often = {t: sum(tf[i, t] > 0 for i, _ in docs) for _, t in terms}
    want = []
    for q in {q for q, _ in terms}:
        mine, scored = [t for p, t in terms if p == q], []
        for i, text in docs:
            size = len((text or "").split())
            parts = [math.log(1 + (n - often[t] + 0.5) / (often[t] + 0.5)) * tf[i, t] * 2.2 / (tf[i, t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in mine if tf[i, t]]
            if parts:
                scored.append((-round(sum(parts), 6), i))
        want += [(q, i, k, -s) for k, (s, i) in enumerate(sorted(scored)[:30])]
    got = S.bm25_best(df, asked, 30)
    assert sorted((r.question, r.id, r["rank"], r.score) for r in got.collect()) == sorted(want)
    known = P.numbered(asked)
    weights = known.select("term", "number").collect()
    weighted = spark.createDataFrame([(q, r.number, math.log(1 + (n - often[t] + 0.5) / (often[t] + 0.5)), mean) for q, t in terms for r in weights if r.term == t], "question long, number long, weight double, mean double")
    held = P.counted(df, known, "id", F.col("content"), most_terms=2)
    assert held.select("pass").distinct().count() > 2
    small = S.best_of(P.best_scores(held, weighted, 30, S.K1, S.B, most_rows=40, most_asked=5), 30)
    assert sorted((r.question, r.id, r["rank"], r.score) for r in small.collect()) == sorted(want)
    assert S.bm25_best(df.limit(0), asked, 3).count() == 0 and S.bm25_best(df, asked.limit(0), 3).count() == 0


def test_no_word_is_shuffled(spark):
    """The plan of the counts has no exchange: a text's words stay in the task that reads it."""
    df = spark.createDataFrame([(1, "a b a"), (2, "b")], "id long, content string")
    counts = P.counted(df, P.numbered(spark.createDataFrame([(1, "a"), (1, "b a")], "question long, term string")), "id", F.col("content"))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.size, sorted(r.counts)) for r in counts.collect()) == [(1, 3, [1, 2]), (2, 1, [])]


def test_phrase_of_many_rows_and_questions(spark):
    """Pairs of a common phrase are made by many tasks, each pair once."""
    docs = spark.createDataFrame([(i, "x of the y" if i % 2 else "the of") for i in range(16_000)], "id long, content string").repartition(5)
    rows = [(q, "of the") for q in range(6)] * 2 + [(20, "of the"), (20, "the y"), (21, "the y"), (21, "no such")]
    got = S.phrase_matches(docs, spark.createDataFrame(rows, "question long, phrase string")).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.question, r.id) for r in got) == sorted((q, i) for q in {q for q, _ in rows} for i in range(1, 16_000, 2))
    tasks = Counter(r.task for r in got if r.question < 20)
    assert len(tasks) > 3 and max(tasks.values()) <= sum(tasks.values()) / 2
    assert S.phrase_matches(docs.limit(0), spark.createDataFrame(rows, "question long, phrase string")).count() == 0

from tessera.llm.unit_dedup import unit_dedup, units


def brute(docs):
    seen, out = set(), []
    for doc, text in docs:
        gone = [False] * len(text)
        # by (start, end), as ranked
        for a, b, words in sorted(units(text, 4)):
            if words in seen:
                gone[a:b] = [True] * (b - a)
            seen.add(words)
        out.append((doc, "".join(c for c, g in zip(text, gone, strict=True) if not g)))
    return sorted(out, key=str)


LINE = "Read the Terms of Use before you copy."
LONG = "One sentence of more than eight words stands within this line. Another sentence of quite as many words comes after it here."


def test_equals_a_plain_loop(spark):
    docs = [(i, f"{LINE}\nown line number {i} of this document\n{LONG}\n{'x ' * (i % 3)}") for i in range(40)]
    docs += [(50, f"  read   THE terms of use before you copy.\nshort\nlead in words here. {LONG.split('. ')[1]} İstanbul"), (51, ""), (52, "\n\n")]
    df = spark.createDataFrame([(t, i, 7, "s") for i, t in docs], "text string, doc_id long, u int, d1 string").repartition(6)
    found = unit_dedup(df, line_words=4)
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == brute(docs)
    first = {r.doc_id: r for r in found.collect()}[0]
    assert first.spans == [] and first.n_chars == len(docs[0][1])


def test_nulls_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, LINE), (1, LINE), (None, LINE), (3, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.text, r.n_chars) for r in unit_dedup(df, line_words=4).collect()), key=str)
    assert rows == sorted([(1, LINE, len(LINE)), (1, "", len(LINE)), (None, "", len(LINE)), (3, "", 0)], key=str)
    assert unit_dedup(df.limit(0), line_words=4).count() == 0

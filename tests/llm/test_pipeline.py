import random
import re
from collections import Counter

import corpus_pipeline
from test_contracts import corpus
from tokenizers import Tokenizer

from tessera.llm.queries import tokenizer_file
from tessera.llm.storage import materialize


def test_stages_keep_what_they_should(spark):
    rows, df = corpus(spark, 150, 6)
    docs, seen = df.drop("digest", "bucket"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""))
        seen.append((name, docs.count(), docs.columns))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _, _ in seen] == ["language_id", "exact_dedup", "simhash_dedup", "source_mixing", "packing"]
    assert all(c == columns for _, _, c in seen[:-1])
    letters = sum(any(x.isalpha() for x in r[1] or "") for r in rows)
    assert seen[0][1] == letters and seen[0][1] >= seen[1][1] >= seen[2][1] > 0
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(seen[-1][2])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def first_of_each_group(rows, alike):
    """Rows (id, text) in order; one of each group of linked ones stays, the first."""
    head = list(range(len(rows)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]):
                a, b = root(i), root(j)
                head[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(rows) if root(i) == i]


def test_run_equals_a_plain_chain(spark, tmp_path):
    """All five stages by run(): the first three against plain loops, the pieces against the library's ids of what the mix took."""
    draw = random.Random(12)
    vocabulary = {x: ["".join(draw.choice(x) for _ in range(draw.randint(2, 7))) for _ in range(80)] for x in ("abcdeé", "mnopqß")}
    rows = []
    for i in range(90):
        lang, alphabet = draw.choice([("ab", "abcdeé"), ("mn", "mnopqß")])
        rows.append((i, " ".join(draw.choice(vocabulary[alphabet]) for _ in range(draw.choice([3, 30, 120]))), lang, f"s{i % 4}"))
    for i in range(60):  # copies: exact but for white space, near, and far
        _, text, lang, source = rows[draw.randrange(90)]
        w = text.split()
        if i % 3:
            w[draw.randrange(len(w))] = "changed"
        rows.append((100 + i, (" " if i % 3 else "\t ").join(w), lang, source))
    rows += [(5, "another text under a known id that shares nothing with it at all", "ab", "s0"), (300, None, "ab", "s1"), (301, "12 34 5", "ab", "s1"), (302, "", None, None), (303, "short x", None, None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs, stages = df, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, str(tmp_path)))
        stages.append(sorted((r.doc_id, r.text) for r in docs.collect()))
    known = sorted((r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert stages[0] == known
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    single = first_of_each_group(known, lambda a, b: plain(a) == plain(b))
    assert stages[1] == single

    def similar(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) >= 0.8 * len(a | b) > 0

    apart = first_of_each_group(single, similar)
    assert len(known) > len(single) > len(apart) and stages[2] == apart
    taken = Counter(stages[3])
    assert set(taken) <= set(apart) and max(taken.values()) <= 3
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = Counter()
    for (i, text), n in taken.items():
        want[i] += n * (len(library.encode(text, add_special_tokens=False).ids) + 1)
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want
    for of in {p.sequence_id for p in pieces}:
        mine = sorted((p.offset, p.length) for p in pieces if p.sequence_id == of)
        assert [o for o, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))] and sum(n for _, n in mine) <= 2048

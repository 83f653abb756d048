"""Phrases against a plain count of every n-gram."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.phrases import phrases, radix_order

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least, cover, top, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        left = []
        for p, a in candidates.items():
            if p not in inside or 100 * inside[p] < cover * a:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                left.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], s))
        left.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(left[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    words = ["Der", "die", "xé", "a\x01", "a", "b", "mit", "to", "zz"]
    made = [(draw.choice(["en", "de", None]), "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for _ in range(draw.randint(0, 60)))) for _ in range(300)]
    return made + [("en", None), (None, ""), ("fr", "..!"), ("en", "a b " * 3000), *[("de", "one hot passage stands here again")] * 40]


@pytest.mark.parametrize("least,top,table", [(20, 2000, 1 << 26), (20, 7, 0), (5, 100, 1 << 26)])
def test_equals_a_plain_count(spark, rows, least, top, table):
    df = spark.createDataFrame([(i, *r, r[1], 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, word string, c int").repartition(5)
    got = phrases(df, least=least, top=top, most_broadcast=table)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain(rows, least, 100, top)
    assert phrases(df.limit(0), least=least, most_broadcast=table).count() == 0


def test_cover_below_the_whole(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    got = phrases(df, least=10, cover=40)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain(rows, 10, 40, 2000)


def test_scores_pass_64_bits(spark):
    """The score's product is exact beyond a long; here on the expression, with counts no fixture can hold."""
    a, n, l, r = 9 * 10**12, 7 * 10**15 + 1, 9 * 10**12 + 7, 3 * 10**13 + 11
    wide = "cast({} as decimal(18, 0))".format
    got = spark.sql(f"select ({wide(a)} * ({wide(n)} * 1000)) div ({wide(l)} * {wide(r)}) as s").first().s
    assert got == 1000 * a * n // (l * r)


def test_radix_order_is_a_sort():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, x, 5000).astype(np.uint64) for x in (3, 1 << 20, 1 << 40)]
    want = np.lexsort(columns[::-1])
    assert (radix_order(columns) == want).all() and len(radix_order([np.zeros(0, np.uint64)])) == 0

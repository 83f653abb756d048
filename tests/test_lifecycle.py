"""Redaction, debt markers, traces and writes against plain loops on small tables."""

import math
import re
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.functions import redact, text
from tessera.operators import graph, lifecycle, search
from tessera.sources.shared import written

NOW = datetime(2024, 6, 1)


def kept(value):
    """Whether a keyed value stays, by the rule as it is told."""
    if re.fullmatch(r"[0-9a-fA-F]{7,12}|[0-9a-fA-F]{40}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value):
        return True
    if value[0] == "$" or "(" in value or (value[0] == "<" and value[-1] == ">") or value.startswith("[REDACTED"):
        return True
    if value.count("/") >= 2 and re.fullmatch(r"[a-z0-9._~/-]+", value):
        return True
    share = [n / len(value) for n in Counter(value).values()]
    return len(value) >= 20 and -sum(p * math.log2(p) for p in share) <= 3.0


def test_keyed_values_one_by_one(spark):
    values = ["hunter22", "a" * 30, "a1B2" * 6 + "xYz0", "$HOME/secret", "call(x)yz", "<your-token>", "<your-tokens", "keys/deploy/id", "Keys/deploy/id", "0123abc", "DEADBEEF99", "f" * 40, "abc/defgh", "[REDACTED:x]"]
    texts = [f"{key}{v} and {key}{v}\nend" for v in values for key in ("password=", "my_token: '", "API_KEY = ")] + ["", "no key here", None, "password=", "x" * 50_000 + " secret=hunter22"]
    want = [t and re.sub(redact.KEYED, lambda m: m[0] if kept(m[2]) else m[1] + "[REDACTED:keyed-secret]", t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(redact.redacted_rows(rows, ["t"]).collect())
    assert [got[i] for i in range(len(texts))] == want
    assert dict(rows.select("i", redact.redacted(F.col("t"))).collect()) == got


def test_json_values_at_any_depth(spark):
    payload = '{"a": "password=hunter22", "n": 3, "deep": [{"b": "token: abcdefgh1", "password": "kept"}, "x"], "q": "say \\\\"hi\\\\""}'.replace("\\\\", "\\")
    rows = spark.createDataFrame([(payload,), ("no json",), (None,)], "p string")
    got = [r[0] for r in rows.select(redact.redacted_json(F.col("p"))).collect()]
    assert got[0] == payload.replace("hunter22", "[REDACTED:keyed-secret]").replace("abcdefgh1", "[REDACTED:keyed-secret]") and got[1:] == [None, None]


def test_debt_in_comments_only(spark):
    source = "// TODO: one\nx = 1 # fixme two\ny = 'no # HACK here'\nz = \"a // BUG b\" // note: three\n/* XXX four\nTODO bare\n-- optimize it\nfine // todone"
    page = "TODO not here\n<!-- TODO: yes --> text\n# FIXME head"
    rows = spark.createDataFrame([(source, "a.ts"), (page, "b.md"), (None, "c.py"), ("", "d.py")], "s string, p string")
    got = {r.p: [(x.line, x.marker) for x in r.d] for r in rows.select("p", text.debt_of(F.col("s"), F.col("p")).alias("d")).collect()}
    assert got["a.ts"] == [(1, "TODO"), (2, "FIXME"), (4, "NOTE"), (5, "XXX"), (7, "OPTIMIZE")]
    assert got["b.md"] == [(2, "TODO")] and got["c.py"] == got["d.py"] == []


def test_trace_says_when_it_is_cut(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0)], "source long, target long")
    seeds = spark.range(1)
    run = lambda depth, limit: [(r.id, r.depth, r.truncated) for r in graph.trace(edges, seeds, depth, limit).collect()]
    assert run(5, 10) == [(1, 1, False), (2, 1, False), (3, 2, False), (4, 3, False)]
    assert run(2, 10) == [(1, 1, True), (2, 1, True), (3, 2, True)] and run(5, 2) == [(1, 1, True), (2, 1, True)]
    assert {(r.id, r.depth) for r in graph.walk(edges, seeds, 2).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2)}
    assert graph.walk(edges.limit(0), seeds, 3).count() == 1 and written(edges).count() == 6


def test_file_kinds(spark):
    cases = {"README.md": 30, "docs/phases/one.md": 25, "a/b.mdx": 15, "Dockerfile": 16, "db/migrations/1.sql": 28, "src/main.rs": 25, "x/a.test.ts": 5, "x/tests/a.py": 3, "x/tests/util/a.py": 5,
             "a/user.service.ts": 18, "src/index.ts": -8, "src/hooks/use.tsx": 12, "app/models.py": 22, "pkg/__init__.py": -5, "x/my_handler.go": 18, "src/lib.rs": 22, "ci.yml": 10, "logo.bin": 3, "web/package.json": 18}
    rows = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.k for r in rows.select("p", graph.file_kind(F.col("p")).alias("k")).collect()} == cases


def test_phrases_are_terms_of_their_own(spark):
    q = spark.createDataFrame([('where is "connection pool" configured',), ('"the" pool',), (None,)], "q string")
    assert [r[0] for r in q.select(text.search_terms(F.col("q"))).collect()] == [["connection pool", "configured"], ["pool"], []]
    docs = spark.createDataFrame([(1, "the connection pool is full"), (2, "pool connection"), (3, "a connection, pool")], "id long, content string")
    terms = spark.createDataFrame([(1, "connection pool")], "question long, term string")
    assert sorted(r.id for r in search.bm25(docs, terms).collect()) == [1, 3]


def test_search_in_blocks_is_the_same(spark):
    rows = [(i, [float((i * 7 + k * 3) % 11 - 5) for k in range(6)]) for i in range(200)] + [(900, [0.0] * 6), (901, [1.0]), (902, [])]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    probes = v.where("id % 10 = 0").select(F.col("id").alias("question"), F.col("vector").alias("probe"))
    one, four = (sorted((r.question, r.id, round(r.similarity, 6)) for r in search.nearest(probes, v, 5, 0.2, blocks=b).collect()) for b in (1, 4))
    assert one == four and all(r[1] < 900 for r in one)


def test_expiry_and_release(spark):
    s = spark.createDataFrame([(1, "active", NOW - timedelta(minutes=50)), (2, "active", NOW - timedelta(minutes=50)), (3, "completed", NOW - timedelta(days=1))], "id long, status string, started_at timestamp")
    activity = spark.createDataFrame([(2, NOW - timedelta(minutes=5), ["a"])], "id long, last_activity timestamp, files array<string>")
    got = lifecycle.expired(s, activity, F.lit(NOW)).collect()
    assert [(r.id, r.minutes, r.summary) for r in got] == [(1, 50, "Auto-expired after 50 minutes of inactivity. No file changes were tracked.")]


def test_term_counts(spark):
    """Words and phrases of any length, overlaps included, and a row with the size of every text."""
    docs = spark.createDataFrame([(1, "a a a b"), (2, "b a, a"), (3, None), (4, "c")], "id long, content string")
    terms = spark.createDataFrame([(1, "a"), (1, "a a"), (2, "a a b"), (2, "a a"), (3, "b b")], "question long, term string")
    got = sorted((r.id, r.size, r.term or "", r.tf) for r in search.term_counts(docs, terms).collect())
    assert got == [(1, 4, "", 1), (1, 4, "a", 3), (1, 4, "a a", 2), (1, 4, "a a b", 1), (2, 3, "", 1), (2, 3, "a", 2), (2, 3, "a a", 1), (3, 0, "", 1), (4, 1, "", 1)]
    phrases = spark.createDataFrame([(7, "a a b"), (8, "b a"), (9, "b a")], "question long, phrase string")
    assert sorted(tuple(r) for r in search.phrase_matches(docs, phrases).collect()) == [(7, 1), (8, 2), (9, 2)]
    assert search.bm25(docs.limit(0), terms).count() == 0 and search.bm25(docs, terms.limit(0)).count() == 0

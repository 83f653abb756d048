"""Hints, recalls and packets on small cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import budgets as B

START = datetime(2024, 1, 1)


def test_within(spark):
    rows = spark.createDataFrame([("a", 1, 50), ("a", 2, 40), ("a", 3, 20), ("a", 4, 1), ("b", 1, 500), ("b", 2, 1), (None, 1, 1)], "g string, k int, size int")
    got = {(r.g, r.k): r.used for r in B.within(rows, "g", [F.col("k")], F.col("size"), 3, 100).collect()}
    assert got == {("a", 1): 50, ("a", 2): 90, ("b", 1): 500, (None, 1): 1}


def symbols(spark, n=9):
    rows = [(i, "parseFile", f"m{i}:parseFile" if i else "m0\n# heading:parseFile", "Function", i) for i in range(n)] + [(90, "loadCache", "x" * 200, "Struct", 3)]
    return spark.createDataFrame(rows, "id int, name string, qualified_name string, label string, start_line int").withColumns({"file_path": F.lit("a.rs"), "fan_in": F.lit(2)})


def test_hints(spark):
    searches = [
        (1, "s", "Grep", "fn parseFile("), (2, "s", "Grep", "parseFile"), (3, "t", "Glob", "**/parseFile*"), (4, "", "Grep", "parseFile"), (5, None, "Grep", "parseFile"), (6, "s", "Read", "parseFile"),
        (7, "s", "Glob", "**/*.ts"), (8, "s", "Grep", None), (9, "s", "Grep", "nothing_known"), (10, "s", "Grep", "loadCache"),
    ]
    df = spark.createDataFrame([(i, s, START + timedelta(seconds=i), t, p) for i, s, t, p in searches], "search_id int, session string, at timestamp, tool string, pattern string")
    got = {r.search_id: r for r in B.search_hints(df, symbols(spark)).collect()}
    assert sorted(got) == [1, 3, 4, 5, 10] and got[1].shown == 5 and got[1].more and got[1].text.startswith("[code map] ") and "the first 5 definition(s)" in got[1].text
    assert "\n# heading" not in got[1].text and got[1].text.count("\n") == 6
    assert not got[10].more and "x" * 120 + "... Struct:3" in got[10].text
    short = {r.search_id: r.text for r in B.search_hints(df, symbols(spark), most_chars=50).collect()}
    assert all(len(t) == 53 and t.endswith("...") for t in short.values())
    assert B.search_hints(df.limit(0), symbols(spark)).count() == 0 and B.search_hints(df, symbols(spark).limit(0)).count() == 0


def test_recall(spark):
    prompts = spark.createDataFrame([(1, "look at loadCache, NEVER parseFile or parseFile"), (2, "plain words only"), (3, None), (4, "parse_file_x")], "id int, text string")
    got = {r.id: r for r in B.prompt_recall(prompts, symbols(spark, 3)).collect()}
    assert got[1].shown == 4 and got[1].recall.count("\n- ") <= 4 and 2 not in got and 3 not in got
    few = {r.id: r for r in B.prompt_recall(prompts, symbols(spark, 3), most_rows=1).collect()}
    assert few[1].shown == 1 and len(few[1].recall) <= 403


def test_context(spark):
    kinds = ["bug", "pattern", "architecture", "note", "user-prompt"]
    entries = spark.createDataFrame([(i, "n", f"t{i}", kinds[i % 5], "x" * 500, START + timedelta(hours=i), None) for i in range(60)] + [(99, "m", None, "bug", None, START, START)], "id int, namespace string, title string, type string, content string, created_at timestamp, deleted_at timestamp")
    sessions = spark.createDataFrame([(i, "n", "completed" if i % 2 else "active", f"g{i}" if i != 5 else None, None, START + timedelta(days=i)) for i in range(8)] + [(50, "only", "active", None, None, START)], "id int, namespace string, status string, goal string, summary string, started_at timestamp")
    got = {r.namespace: r for r in B.context_texts(entries, sessions, ("user-prompt",)).collect()}
    lines = got["n"].text.split("\n")
    assert (got["n"].n_entries, got["n"].n_sessions) == (60, 8) and sum(x.startswith("- **") for x in lines) == 32
    assert [x for x in lines if x.startswith("- Session")] == ["- Session 2024-01-08: g7", "- Session 2024-01-06", "- Session 2024-01-04: g3"]
    assert {len(x.split("]: ")[1]) for x in lines if "[bug]" in x} == {403} and {len(x.split("]: ")[1]) for x in lines if "[note]" in x} == {203}
    assert got["only"].text == "## Memory Context (restored after compaction)\n\n### Stats\n- 0 memory entries | 1 sessions\n- Namespaces: only" and "m" not in got

"""Rules on small tables: layers, redaction, streams, sources."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.functions import redact, text
from tessera.operators import entries
from tessera.sources import files
from tessera.streaming import sessions

NOW = datetime(2024, 6, 1)


def test_layer_rules(spark):
    cases = [(1, 0, True, 0.9, 0, 3), (1, 5, False, 0.9, 0, 2), (2, 5, False, 0.9, 0, 3), (1, 0, False, 0.3, 14, 4), (1, 0, False, 0.3, 7, 2), (3, 0, False, 0.9, 30, 4), (1, 2, False, 0.9, 3, None), (3, 0, True, 0.9, 0, None)]
    rows = [(layer, n, v, c, None, NOW - timedelta(days=d), want) for layer, n, v, c, d, want in cases]
    df = spark.createDataFrame(rows, "layer int, access_count int, verified boolean, confidence double, last_accessed_at timestamp, created_at timestamp, want int")
    assert all(r.want == r.got for r in df.withColumn("got", entries.next_layer(F.lit(NOW))).collect())


def test_search_terms(spark):
    cases = [("how does authentication work here", ["authentication", "work"]), ("user-facing errors", ["user", "facing", "errors"]), ("cache the cache CACHE", ["cache"]), ("how is it that we should do this", []), ("", [])]
    df = spark.createDataFrame([(q,) for q, _ in cases], "q string")
    assert [r[0] for r in df.select(text.search_terms(F.col("q"))).collect()] == [t for _, t in cases]
    assert df.sparkSession.range(1).select(text.search_phrases(F.lit('where is "Connection pool" configured'))).first()[0] == ["connection pool"]


def test_redaction_pairs(spark):
    gh, jwt = "gh" + "p_" + "a1" * 18, ".".join("eyJ" + "x" * 9 for _ in range(2)) + "." + "y" * 9
    secret = [f"a {gh} b", f"t {jwt} u", "api_key = hunter22", "-----BEGIN " + "PRIVATE KEY-----\nabc"]
    prose = ["the key to success", "token=$TOKEN", "commit_key=deadbeef1", "path_key=a/b/c/deploy", "secret=" + "a" * 30, None]
    df = spark.createDataFrame([(x,) for x in secret + prose], "t string").coalesce(1)
    got = [r[0] for r in df.select(redact.redacted(F.col("t"))).collect()]
    assert all("[REDACTED:" in x for x in got[:4]) and got[4:] == prose


def test_stored_rows_chain_and_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=s), "u", 1.0) for i, s in enumerate([0, 20, 31, 45, 60, 62, 200])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id string, value double")
    want = [0, 2, 5, 6]
    assert sorted(r.event_id for r in sessions.throttled(df, ["user_id"]).collect()) == want
    assert sorted(r.event_id for r in sessions.throttled(df, ["user_id"], most=2).collect()) == want[:2]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = sessions.throttled_stream(stream, "user_id").writeStream.format("memory").queryName("stored").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.event_id for r in spark.table("stored").collect()) == want


def test_changes_by_micro_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "b", 2)], "id long, entry_id string, created_at long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sessions.apply_changes(stream, str(tmp_path / "out")).awaitTermination(120)
    got = {(r.entry_id, r.id, r.subsumed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 2, 1), ("b", 3, 0)}


def test_files(spark, tmp_path):
    for name, body in (("a.py", "x\ny"), ("node_modules/b.js", "z"), (".hidden", "q"), ("src/c.md", "1\n2\n3")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(body)
    assert sorted((r.path, r.lines) for r in files.inventory(spark, str(tmp_path)).collect()) == [("a.py", 2), ("src/c.md", 3)]
    lines = spark.createDataFrame([("M\ta",), ("R100\tb\tc",), ("bad",), ("D\td",)], "value string")
    assert {tuple(r) for r in files.change_list(lines).collect()} == {("a", "modified"), ("b", "deleted"), ("c", "added"), ("d", "deleted")}
    tagged = spark.createDataFrame([('{"kind":"entry","data":{"id":1,"t":"x"}}',), ('{"id":2,"t":"y"}',), ("{broken",), ('{"kind":"edge","data":{}}',)], "value string")
    schema = spark.createDataFrame([], "id long, t string").schema
    assert sorted(tuple(r) for r in files.parse_tagged(tagged, schema).collect()) == [(1, "x"), (2, "y")] and files.bad_lines(tagged).count() == 1

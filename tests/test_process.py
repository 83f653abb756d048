"""Sessions as a process: batch form against a plain list, stream form against the batch form."""

import random
from datetime import datetime, timedelta

from tessera.streaming import process as P

EVENTS = "key string, ts timestamp, event_id long, kind string, text string, file string"
START = datetime(2024, 1, 1)


def micros(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def told(rows):
    return sorted(((r.key, r.row, r.at, r.started_at, r.status, r.goal, r.summary, r.n_files, tuple(r.files), tuple(r.tags)) for r in rows), key=str)


def test_one_session_of_each_end(spark):
    at = lambda s: START + timedelta(seconds=s)
    made = [
        ("a", at(0), 1, "activity", None, "x"), ("a", at(1800), 2, "prompt", "fix it", "y"), ("a", at(1801), 3, "prompt", "later", "x"), ("a", at(5000), 4, "checkpoint", "half way", None),
        ("a", at(5001), 5, "end", "done", "z"), ("a", at(5001), 6, "activity", None, None), (None, at(0), 7, "activity", None, None), ("b", None, 8, "activity", None, None),
    ]
    got = told(P.session_rows(spark.createDataFrame(made, EVENTS), micros(at(90_000))).collect())
    rows = [(r[0], r[1], r[2], r[4], r[5], r[6], r[7], r[8]) for r in got]
    expired = "Auto-expired after 30 minutes of inactivity. "
    assert sorted(rows, key=str) == sorted([
        ("a", "start", at(0), "active", P.AUTOMATIC, None, 0, ()), ("a", "end", at(3601), "completed", "fix it", expired + "2 file(s) modified: x, y.", 2, ("x", "y")), ("a", "entry", at(3601), "completed", "fix it", expired + "2 file(s) modified: x, y.", 2, ("x", "y")),
        ("a", "start", at(5000), "active", P.AUTOMATIC, None, 0, ()), ("a", "entry", at(5000), "active", None, "half way", 0, ()), ("a", "end", at(5001), "completed", None, "done", 1, ("z",)), ("a", "entry", at(5001), "completed", None, "done", 1, ("z",)),
        ("a", "start", at(5001), "active", P.AUTOMATIC, None, 0, ()), ("a", "end", at(6801), "completed", None, expired + "No file changes were tracked.", 0, ()), ("a", "entry", at(6801), "completed", None, expired + "No file changes were tracked.", 0, ()),
        (None, "start", at(0), "active", P.AUTOMATIC, None, 0, ()), (None, "end", at(1800), "completed", None, expired + "No file changes were tracked.", 0, ()), (None, "entry", at(1800), "completed", None, expired + "No file changes were tracked.", 0, ()),
    ], key=str)
    assert P.session_rows(spark.createDataFrame([], EVENTS), 0).count() == 0


def test_stream_and_batch_agree(spark, tmp_path):
    draw, made = random.Random(7), []
    for i, s in enumerate(sorted(draw.randrange(60_000) for _ in range(240))):
        kind = draw.choice(["activity"] * 6 + ["prompt", "checkpoint", "end"])
        made.append((f"k{draw.randrange(4)}", START + timedelta(seconds=s), i, kind, f"t{i}", draw.choice([None, f"f{draw.randrange(9)}"])))
    # a last event of another key moves the watermark past every bound
    made += [("zz", START + timedelta(days=2), 1000, "end", "x", None), ("zz", START + timedelta(days=2), 1001, "end", "x", None)]
    for k in range(0, len(made), 60):
        spark.createDataFrame(made[k : k + 60], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = P.session_stream(stream).writeStream.format("memory").queryName("session_rows").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    batch = P.session_rows(spark.createDataFrame(made, EVENTS).repartition(5), micros(START + timedelta(days=3)))
    assert told(spark.table("session_rows").collect()) == told(batch.collect())

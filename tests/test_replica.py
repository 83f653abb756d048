"""Pulls that break off, batches that are replayed, and an outbox stream."""

import json
import random
from datetime import datetime, timedelta

import pytest

from tessera.streaming.replica import Replica, bootstrap, pull, push_batch, push_stream

SCHEMA = "id long, content string, updated_at timestamp, verified boolean, deleted_at timestamp"
START = datetime(2024, 1, 1)


def micros(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def replica(spark, path):
    return Replica(spark, f"file://{path}/table", spark.createDataFrame([], SCHEMA).schema, 4)


def rows(spark, made):
    return spark.createDataFrame([(i, c, START + timedelta(seconds=s), v, START if d else None) for i, c, s, v, d in made], SCHEMA).repartition(3)


def held(r):
    return sorted((x.id, x.content) for x in r.rows().collect())


def test_pull_breaks_off_and_resumes(spark, tmp_path):
    draw, own = random.Random(5), replica(spark, tmp_path)
    first = [(i, "a", i % 7, False, False) for i in range(60)]
    assert {r.action for r in bootstrap(own, rows(spark, first), micros(START + timedelta(seconds=10))).collect()} == {"insert"}
    remote = rows(spark, first[:20] + [(i, "b", 10 + draw.randrange(12), False, i % 9 == 0) for i in range(20, 90)] + [(99, "late", 29, False, False), (None, "no id", 15, False, False)])
    now = micros(START + timedelta(seconds=30))
    with pytest.raises(RuntimeError):
        pull(own, remote, now, page_rows=20, fail_after=1)
    assert own.cursor()[0] == 1
    got = pull(own, remote, now, page_rows=20)
    assert held(own) == [(i, "a") for i in range(20)] + [(i, "b") for i in range(20, 90)]
    assert got["cursor"] == micros(START + timedelta(seconds=21)) and got["pages"] >= 2
    assert pull(own, remote, now, page_rows=20) == {"fetched": 0, "pages": 0, "cursor": got["cursor"]}
    assert pull(own, remote, now + 10_000_000, page_rows=1)["insert"] == 1 and (99, "late") in held(own)
    with pytest.raises(ValueError, match="bootstrap"):
        pull(replica(spark, tmp_path / "new"), remote, now)


def test_resolver_and_replay(spark, tmp_path):
    own = replica(spark, tmp_path)
    own.upsert(0, rows(spark, [(1, "old", 5, False, False), (2, "sure", 5, True, False), (3, "gone", 5, False, True), (4, "same", 5, False, False)]))
    more = rows(spark, [(1, "new", 9, False, False), (2, "new", 9, False, False), (3, "new", 9, False, False), (4, "older", 1, False, False), (5, "first", 1, False, False)])
    want = {1: ("update", False), 2: ("skip", True), 3: ("skip", True), 4: ("skip", False), 5: ("insert", False)}
    for _ in range(2):
        assert {r.id: (r.action, r.audited) for r in own.upsert(1, more).collect()} == want
        assert held(own) == [(1, "new"), (2, "sure"), (3, "gone"), (4, "same"), (5, "first")]
    own.upsert(0, rows(spark, [(7, "other", 1, False, False)]))  # an earlier batch that is run again does not reach into later ones
    assert (1, "new") in held(own) and own.upsert(2, more.limit(0)).count() == 0


def entry(i, content, seconds, **more):
    return json.dumps({"id": i, "content": content, "updated_at": (START + timedelta(seconds=seconds)).isoformat() + "Z"} | more)


OUTBOX = "id long, entry_id long, row_payload string, attempts int, created_at timestamp"


def outbox(spark, made):
    return spark.createDataFrame([(k, i, p, a, START + timedelta(seconds=s)) for k, i, p, a, s in made], OUTBOX)


def test_push_confirms_with_its_representative(spark, tmp_path):
    own = replica(spark, tmp_path)
    made = [(1, 1, entry(1, "a", 1), 0, 1), (2, 1, entry(1, "b", 2), 3, 2), (3, 2, "{broken", 4, 2), (4, 2, entry(2, "x", 1), 0, 1), (5, 3, None, 0, 1), (6, 4, entry(5, "other", 1), 0, 1), (7, 6, '{"id":6}', 0, 1), (8, 7, entry(7, "c", 1, verified=True), 0, 1)]
    for _ in range(2):
        got = {r.id: (r.status, r.attempts) for r in push_batch(own, 0, outbox(spark, made)).collect()}
        assert got == {1: ("confirmed", 0), 2: ("confirmed", 3), 3: ("released", 4), 4: ("released", 0), 5: ("released", 0), 6: ("released", 0), 7: ("released", 0), 8: ("confirmed", 0)}
        assert held(own) == [(1, "b"), (7, "c")]


def test_push_stream(spark, tmp_path):
    own, folder = replica(spark, tmp_path), f"{tmp_path}/in"
    made = [(k, k % 10, entry(k % 10, f"v{k}", k), 0, k) for k in range(40)]
    outbox(spark, made[:25]).coalesce(1).write.mode("append").parquet(folder)

    def run(table, checkpoint):
        stream = spark.readStream.schema(OUTBOX).option("maxFilesPerTrigger", 1).parquet(folder)
        push_stream(table, stream, f"{tmp_path}/{checkpoint}").awaitTermination()

    run(own, "c")
    outbox(spark, made[25:]).coalesce(1).write.mode("append").parquet(folder)
    run(own, "c")
    want = [(i, f"v{30 + i}") for i in range(10)]
    assert held(own) == want
    run(own, "again")  # all batches once more, over a table that holds them
    assert held(own) == want

"""Pulls and pushes between tables of documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import new_folder
from tessera.streaming.replica import Replica, bootstrap, pull, push_batch

from .registry import query
from .tables import derived, table

_START = 1704067200
#: a remote row for each document, some changed after the bootstrap, some at equal times, some too late for the pull
REMOTE = f"""SELECT doc_id AS id, text AS content, {_START} + CASE WHEN doc_id % 4 = 0 THEN 5000 + (doc_id * 7919) % 600 WHEN doc_id % 97 = 1 THEN 9999 ELSE doc_id % 1000 END AS updated, doc_id % 5 = 0 AS verified,
  CASE WHEN doc_id % 12 = 0 THEN {_START} END AS deleted FROM {{documents}}"""
#: what the replica holds of its own: part of the documents, newer, older, verified or deleted
LOCAL = f"""SELECT doc_id AS id, concat('own ', lang) AS content, {_START} + CASE WHEN doc_id % 3 = 0 THEN 9000 ELSE 10 END AS updated, doc_id % 8 = 0 AS verified, CASE WHEN doc_id % 28 = 0 THEN {_START} END AS deleted FROM {{documents}} WHERE doc_id % 2 = 0"""
_SCHEMA = "id long, content string, updated_at timestamp, verified boolean, deleted_at timestamp"
#: which side a row is taken from: l is what the table holds, r what comes in
_WINS = """l.id IS NULL OR NOT (l.deleted IS NOT NULL AND r.deleted IS NULL) AND ((l.deleted IS NULL AND r.deleted IS NOT NULL)
  OR (NOT (l.verified AND NOT r.verified) AND ((NOT l.verified AND r.verified) OR r.updated > l.updated)))"""


def _timed(df: DataFrame) -> DataFrame:
    return df.select("id", "content", F.timestamp_seconds("updated").alias("updated_at"), "verified", F.timestamp_seconds("deleted").alias("deleted_at"))


def _replica(spark: SparkSession, schema: str = _SCHEMA) -> Replica:
    return Replica(spark, new_folder(spark, "replica"), spark.createDataFrame([], schema).schema, 8)


def _merge(local: str, incoming: str) -> str:
    """SQL of the table ``local`` after ``incoming`` has been merged."""
    return f"""(SELECT l.* FROM {local} l LEFT JOIN {incoming} r USING (id) WHERE r.id IS NULL OR NOT ({_WINS}) UNION ALL SELECT r.* FROM {incoming} r LEFT JOIN {local} l USING (id) WHERE {_WINS})"""


@query(f"""WITH remote AS ({REMOTE.format(documents='documents')}), own AS ({LOCAL.format(documents='documents')}), old AS (SELECT * FROM remote WHERE updated < {_START + 5000}), new AS (SELECT * FROM remote WHERE updated >= {_START + 5000} AND updated <= {_START + 9000}),
  start AS {_merge('own', 'old')}, done AS {_merge('start', 'new')} SELECT id, content, updated, verified, deleted FROM done""")
def pulled_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica with rows of its own is bootstrapped and then pulls, page by page, what changed since; the last changes are within the clocks' skew."""
    remote, replica = _timed(derived(spark, sf_dir, REMOTE, "documents")), _replica(spark)
    replica.upsert(0, _timed(derived(spark, sf_dir, LOCAL, "documents")))
    replica.move_cursor(0, 0)
    early = remote.where(F.col("updated_at") < F.timestamp_seconds(F.lit(_START + 5000)))
    bootstrap(replica, early, (_START + 5000) * 1_000_000)
    pull(replica, remote, (_START + 9002) * 1_000_000, page_rows=max(20, remote.count() // 12))
    return replica.rows().select("id", "content", F.unix_seconds("updated_at").alias("updated"), "verified", F.unix_seconds("deleted_at").alias("deleted"))


#: an outbox row for each event: the entry of its user with a JSON payload, among them broken ones and ones of another entry; two batches
OUTBOX = f"""SELECT event_id AS id, user_id AS entry_id, {_START} + event_id % 1009 AS created, CAST(event_id % 4 AS INT) AS attempts, CASE WHEN event_id % 11 < 6 THEN 0 ELSE 1 END AS batch, CASE WHEN event_id % 17 = 0 THEN concat('{{{{"id":', CAST(user_id AS STRING)) WHEN event_id % 19 = 0 THEN '{{{{"content":"no id"}}}}'
  ELSE concat('{{{{"id":', CAST(user_id AS STRING), ',"content":"', event_type, CAST(event_id AS STRING), '","updated_at":"', CASE WHEN event_id % 2 = 0 THEN '2024-02-01' ELSE '2024-01-15' END, 'T00:00:00Z","verified":', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, '}}}}') END AS payload FROM {{events}}"""
_OUT = f"""o AS ({OUTBOX.format(events='events').replace('{{', '{').replace('}}', '}')}),
  rep AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY batch, entry_id ORDER BY created DESC, id) = 1),
  good AS (SELECT batch, entry_id AS id, json_extract_string(payload, '$.content') AS content, CASE WHEN contains(payload, '2024-02-01') THEN 1706745600 ELSE 1705276800 END AS updated, contains(payload, 'true') AS verified, NULL::BIGINT AS deleted FROM rep WHERE json_valid(payload) AND json_extract_string(payload, '$.id') = entry_id::VARCHAR),
  b0 AS (SELECT id, content, updated, verified, deleted FROM good WHERE batch = 0), b1 AS (SELECT id, content, updated, verified, deleted FROM good WHERE batch = 1), none AS (SELECT * FROM b0 WHERE false)"""


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    rows = spark.sql(OUTBOX, events=made)
    return rows.select("id", "entry_id", F.col("payload").alias("row_payload"), "attempts", F.timestamp_seconds("created").alias("created_at"), "batch")


def _pushed(spark: SparkSession, sf_dir: str):
    rows, replica = _outbox(spark, sf_dir), _replica(spark)
    # a batch that is run again changes nothing
    status = {n: push_batch(replica, n, rows.where(F.col("batch") == n).drop("batch")) for n in (0, 1, 1)}
    return replica, status


@query(f"WITH {_OUT}, done AS {_merge('b0', 'b1')} SELECT id, content, updated, verified FROM done")
def pushed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after two batches of an outbox, the second one run twice."""
    return _pushed(spark, sf_dir)[0].rows().select("id", "content", F.unix_seconds("updated_at").alias("updated"), "verified")


@query(f"WITH {_OUT} SELECT o.id, o.entry_id, CASE WHEN g.id IS NULL THEN 'released' ELSE 'confirmed' END AS status, attempts FROM o LEFT JOIN good g ON g.batch = o.batch AND g.id = o.entry_id")
def push_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outbox row: confirmed with what stands for it, or released without a further attempt."""
    status = _pushed(spark, sf_dir)[1]
    return status[0].union(status[1])

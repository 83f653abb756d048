"""Tables of entries, changes, symbols and files derived from the driver's tables.

Each is one SQL text that Spark and the SQL oracle both read; times are whole seconds there and become timestamps here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1711929600  # 2024-04-01

ENTRIES = """
SELECT doc_id AS id, source AS namespace, substr(text, 1, 40) AS title, text AS content, lang AS author,
  CASE doc_id % 5 WHEN 0 THEN 'note' WHEN 1 THEN 'decision' WHEN 2 THEN 'user-prompt' WHEN 3 THEN 'architecture' ELSE 'session' END AS type,
  CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'agent' WHEN 2 THEN 'scout' ELSE 'system' END AS source,
  CAST(1 + doc_id % 4 AS INT) AS layer, CAST(doc_id % 7 AS INT) AS access_count, CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence,
  doc_id % 3 = 0 AS verified, CASE WHEN doc_id % 2 = 0 THEN concat('topic:', CAST(doc_id % 40 AS STRING)) END AS topic_key,
  1704067200 + (doc_id * 7919) % 7776000 AS created, 1704067200 + (doc_id * 15485863) % 7776000 AS updated,
  CASE WHEN doc_id % 7 > 0 THEN 1704067200 + (doc_id * 104729) % 7776000 END AS accessed,
  CASE WHEN doc_id % 11 = 0 THEN 1704067200 + (doc_id * 32452843) % 7776000 END AS deleted
FROM {documents}
"""
CHANGES = """
SELECT event_id AS id, user_id AS entry_id, event_type AS op_kind, props AS row_payload, CAST(event_id % 12 AS INT) AS attempts,
  1704067200 + (event_id * 7919) % 2592000 AS created,
  CASE WHEN event_id % 3 = 0 THEN 1704067200 + event_id END AS claimed, CASE WHEN event_id % 5 = 0 THEN 1704067200 + event_id END AS confirmed
FROM {events}
"""
#: one graph of orders, parts and suppliers; ids of the three are told apart by their remainder
CALLS = "SELECT l_partkey * 3 + 1 AS source, l_suppkey * 3 + 2 AS target, CAST(l_linenumber AS INT) AS line FROM {lineitem}"
CHAIN = """SELECT DISTINCT l_orderkey * 3 AS source, l_partkey * 3 + 1 AS target FROM {lineitem} UNION SELECT l_partkey * 3 + 1, l_suppkey * 3 + 2 FROM {lineitem}
  UNION SELECT l_suppkey * 3 + 2, l_orderkey * 3 FROM {lineitem} WHERE l_linenumber = 7"""
NODES = "SELECT o_orderkey * 3 AS id FROM {orders} UNION ALL SELECT p_partkey * 3 + 1 FROM {part} UNION ALL SELECT s_suppkey * 3 + 2 FROM {supplier}"
SESSIONS = """SELECT o_orderkey AS id, concat('src', CAST(o_custkey % 20 AS STRING)) AS namespace,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'abandoned' END AS status,
  CASE WHEN o_orderkey % 3 > 0 THEN concat('goal ', CAST(o_orderkey % 17 AS STRING)) ELSE 'Auto-started session' END AS goal,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS summary, 1704067200 + (o_orderkey * 7919) % 7776000 AS started FROM {orders}"""
EDGES = """SELECT doc_id AS from_id, CAST(floor(doc_id / 2) AS BIGINT) AS to_id,
  CASE doc_id % 3 WHEN 0 THEN 'related' WHEN 1 THEN 'supersedes' ELSE 'supports' END AS type, CAST(doc_id % 10 AS DOUBLE) / 10 AS strength FROM {documents}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def _timed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.timestamp_seconds(c).alias(names[c]) if c in names else c for c in df.columns))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(derived(spark, sf_dir, ENTRIES, "documents"), created="created_at", updated="updated_at", accessed="last_accessed_at", deleted="deleted_at")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(derived(spark, sf_dir, CHANGES, "events"), created="created_at", claimed="claimed_at", confirmed="confirmed_at")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed(derived(spark, sf_dir, SESSIONS, "orders"), started="started_at")
    return rows.withColumn("ended_at", F.lit(None).cast("timestamp"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, EDGES, "documents")


def tagged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with tags: their author's language, their source, and the namespace as a file."""
    return entries(spark, sf_dir).withColumn("tags", F.array("author", "source", F.concat("namespace", F.lit(".rs"))))


def now():
    return F.timestamp_seconds(F.lit(NOW))


def with_tables(sql: str) -> str:
    """Oracle text: the derived tables as common table expressions in front."""
    named = {"entries": ENTRIES, "changes": CHANGES, "calls": CALLS, "chain": CHAIN, "nodes": NODES, "sessions": SESSIONS, "edges": EDGES}
    heads = [f"{k} AS ({v.format(documents='documents', events='events', lineitem='lineitem', orders='orders', part='part', supplier='supplier')})" for k, v in named.items()]
    return f"WITH {', '.join(heads)}, live AS (SELECT * FROM entries WHERE deleted IS NULL), answer AS ({sql}) SELECT * FROM answer"

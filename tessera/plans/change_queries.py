"""Change logs, queues, snapshots, sessions and throttles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import replication as R
from tessera.operators.entries import live
from tessera.sources import files as S
from tessera.streaming import sessions as W

from .registry import query
from .tables import NOW, changes, entries, table, with_tables


@query(with_tables("""SELECT entry_id, id, op_kind, subsumed FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY created DESC, id) AS k,
  count(*) OVER (PARTITION BY entry_id) - 1 AS subsumed FROM changes) WHERE k = 1"""))
def coalesce_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coalesced(changes(spark, sf_dir)).select("entry_id", "id", "op_kind", "subsumed")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return R.latest_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


def _sides(spark, sf_dir):
    rows = entries(spark, sf_dir).select("id", "verified", "updated_at", "deleted_at")
    incoming = rows.select("id", (F.col("id") % 4 == 0).alias("verified"), F.timestamp_seconds(F.unix_seconds("updated_at") + (F.col("id") % 3 - 1) * 1000).alias("updated_at"), F.when(F.col("id") % 13 == 0, F.col("updated_at")).alias("deleted_at"))
    return rows.where("id % 5 <> 0"), incoming


@query(with_tables("""SELECT id, action, here AND ((gone AND NOT rgone) OR (gone = rgone AND verified AND NOT rv)) AS audited FROM (
  SELECT id, deleted IS NOT NULL AS gone, id % 13 = 0 AS rgone, verified, id % 4 = 0 AS rv, id % 5 <> 0 AS here,
    CASE WHEN id % 5 = 0 THEN 'insert' WHEN deleted IS NOT NULL AND id % 13 <> 0 THEN 'skip' WHEN deleted IS NULL AND id % 13 = 0 THEN 'update'
         WHEN verified AND id % 4 <> 0 THEN 'skip' WHEN NOT verified AND id % 4 = 0 THEN 'update' WHEN id % 3 = 2 THEN 'update' ELSE 'skip' END AS action FROM entries)"""))
def conflicts(spark, sf_dir):
    return R.merged(*_sides(spark, sf_dir))


@query(with_tables("SELECT count(*) AS rows, count(*) FILTER (deleted IS NOT NULL) AS gone FROM (SELECT id, CASE WHEN w THEN CASE WHEN id % 13 = 0 THEN updated END ELSE deleted END AS deleted FROM (SELECT *, CASE WHEN id % 5 = 0 THEN true WHEN deleted IS NOT NULL AND id % 13 <> 0 THEN false WHEN deleted IS NULL AND id % 13 = 0 THEN true WHEN verified AND id % 4 <> 0 THEN false WHEN NOT verified AND id % 4 = 0 THEN true ELSE id % 3 = 2 END AS w FROM entries))"))
def apply_remote(spark, sf_dir):
    return R.applied(*_sides(spark, sf_dir)).agg(F.count("*").alias("rows"), F.count("deleted_at").alias("gone"))


@query(with_tables(f"SELECT id, updated FROM entries WHERE updated > 1706000000 AND updated <= {NOW} - 2 ORDER BY updated, id LIMIT 300"))
def cursor_page(spark, sf_dir):
    page = R.change_page(entries(spark, sf_dir), F.timestamp_seconds(F.lit(1706000000)), F.timestamp_seconds(F.lit(NOW)), 300)
    return page.select("id", F.unix_seconds("updated_at").alias("updated"))


@query(with_tables("SELECT id FROM entries WHERE deleted IS NOT NULL AND id IN (SELECT entry_id FROM changes) AND id NOT IN (SELECT entry_id FROM changes WHERE op_kind = 'error' AND id % 40 = 0)"))
def missing_deletes(spark, sf_dir):
    log = changes(spark, sf_dir).select("entry_id", F.when((F.col("op_kind") == "error") & (F.col("id") % 40 == 0), "delete").otherwise("update").alias("op_kind"))
    return R.missing_deletes(entries(spark, sf_dir), log).select("id")


@query(with_tables("""SELECT count(*) FILTER (o AND NOT d AND claimed IS NULL) AS pending, count(*) FILTER (o AND NOT d AND claimed IS NOT NULL) AS in_flight, count(*) FILTER (o AND d) AS dead,
  min(created) FILTER (o) AS oldest, max(created) FILTER (o) AS newest FROM (SELECT *, confirmed IS NULL AS o, attempts >= 10 AS d FROM changes)"""))
def queue_health(spark, sf_dir):
    got = R.queue_health(changes(spark, sf_dir))
    return got.withColumn("oldest", F.unix_seconds("oldest")).withColumn("newest", F.unix_seconds("newest"))


@query(with_tables("""SELECT id, CASE WHEN id % 6 = 0 THEN 1 ELSE attempts END AS attempts, claimed IS NOT NULL AND id % 6 <> 0 AS held, confirmed IS NOT NULL OR id % 6 = 3 AS confirmed
  FROM (SELECT id, CASE WHEN id % 6 = 0 THEN attempts + 1 ELSE attempts END AS attempts, claimed, confirmed FROM changes WHERE id % 12 = 0 AND id % 6 <> 0 UNION ALL SELECT id, attempts, claimed, confirmed FROM changes WHERE id % 6 <> 0)"""))
def outbox_confirm(spark, sf_dir):
    rows = changes(spark, sf_dir)
    results = rows.where("id % 3 = 0").select("id", (F.col("id") % 6 == 3).alias("ok"))
    done = R.outbox_step(rows, results, F.timestamp_seconds(F.lit(NOW))).where("id % 6 <> 0")
    return done.select("id", "attempts", F.col("claimed_at").isNotNull().alias("held"), F.col("confirmed_at").isNotNull().alias("confirmed"))


@query(with_tables("SELECT id, created FROM changes WHERE claimed IS NULL AND confirmed IS NULL ORDER BY created, id LIMIT 100"))
def first_claims(spark, sf_dir):
    return R.first_claims(changes(spark, sf_dir), 100).select("id", F.unix_seconds("created_at").alias("created"))


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
  FROM (SELECT page_id AS path, md5(url) AS h FROM pages WHERE page_id % 7 <> 0) a FULL JOIN (SELECT page_id AS path, CASE WHEN page_id % 3 = 0 THEN md5(html) ELSE md5(url) END AS h FROM pages WHERE page_id % 5 <> 0) b
  ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.h <> b.h""")
def snapshot_diff(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumnRenamed("page_id", "path")
    before = p.where("path % 7 <> 0").select("path", F.md5("url").alias("hash"))
    after = p.where("path % 5 <> 0").select("path", F.when(F.col("path") % 3 == 0, F.md5("html")).otherwise(F.md5("url")).alias("hash"))
    return R.snapshot_diff(before, after)


@query(with_tables("SELECT path FROM (SELECT page_id AS path FROM pages WHERE page_id % 10 < 3 UNION SELECT source FROM chain WHERE target IN (SELECT page_id FROM pages WHERE page_id % 10 IN (1, 2)))"))
def affected_files(spark, sf_dir):
    from .graph_queries import chain

    k = F.col("page_id") % 10
    change = F.when(k == 0, "added").when(k == 1, "modified").when(k == 2, "deleted")
    return R.affected(table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), change.alias("change")).where("change is not null"), chain(spark, sf_dir))


@query("SELECT event_id, json_extract_string(props, '$.k') IS NULL AS malformed, length(json_extract_string(props, '$.k')) > 1 AS oversized FROM events")
def payload_checks(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.isNull().alias("malformed"), (F.length(k) > 1).alias("oversized"))


@query("""SELECT user_id, epoch_us(min(ts)) // 1000000 AS started, epoch_us(max(ts)) // 1000000 AS last_event, count(*) AS events FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def sessions(spark, sf_dir):
    got = W.sessions(table(spark, sf_dir, "events"), gap="6 hours")
    return got.withColumn("started", F.unix_seconds(F.col("started").cast("timestamp"))).withColumn("last_event", F.unix_seconds(F.col("last_event").cast("timestamp")))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT user_id, event_type, k, event_id, t AS last, true AS stored FROM e WHERE k = 1 UNION ALL
        SELECT e.user_id, e.event_type, e.k, e.event_id, CASE WHEN e.t - r.last >= 21600000000 THEN e.t ELSE r.last END, e.t - r.last >= 21600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.k = r.k + 1)
  SELECT user_id, event_type, event_id FROM r WHERE stored""")
def stored_rows(spark, sf_dir):
    got = W.throttled(table(spark, sf_dir, "events"), ["user_id", "event_type"], gap_seconds=6 * 3600)
    return got.select("user_id", "event_type", "event_id")


@query("SELECT event_id, d AS idle FROM (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT AS d FROM events) WHERE d >= 36000")
def nudges(spark, sf_dir):
    from datetime import timedelta

    return W.nudges(table(spark, sf_dir, "events"), idle=timedelta(hours=10)).select("event_id", "idle")


@query(with_tables("SELECT id, title, layer FROM live WHERE id % 3 <> 0"))
def jsonl_round_trip(spark, sf_dir):
    """Rows to tagged JSON lines and back, absent ids only."""
    rows = live(entries(spark, sf_dir)).select("id", "title", "layer")
    edges = rows.select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"))
    lines = S.tagged_lines(rows, edges, rows.limit(0))
    return S.absent_only(S.parse_tagged(lines, rows.schema), rows.where("id % 3 = 0"))


@query(with_tables("SELECT count(*) AS edges FROM live a JOIN live b ON b.id = a.id + 1"))
def exported_edges(spark, sf_dir):
    rows = live(entries(spark, sf_dir)).select("id")
    lines = S.tagged_lines(rows, rows.select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id")), rows.limit(0))
    return lines.where("value like '{\"kind\":\"edge\"%'").agg(F.count("*").alias("edges"))

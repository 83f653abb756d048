"""Lookups, writes, retention and reports over entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import entries as E
from tessera.operators import search as R
from tessera.operators import stats as S

from .registry import query
from .tables import NOW, changes, entries, now, table, with_tables

at = lambda seconds: F.timestamp_seconds(F.lit(seconds))
HASH = "sha256(trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')) || chr(10) || trim(regexp_replace(lower(coalesce(content, '')), '\\s+', ' ', 'g')))"
CUTOFF = 1707955200


@query(with_tables("SELECT id, namespace, type FROM live WHERE id % 9 = 0"))
def live_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    return E.by_ids(rows, rows.where("id % 9 = 0")).select("id", "namespace", "type")


@query(with_tables("SELECT id, deleted IS NOT NULL AS gone FROM entries WHERE id % 9 = 0"))
def any_by_id(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return E.by_ids(rows, rows.where("id % 9 = 0"), with_deleted=True).select("id", F.col("deleted_at").isNotNull().alias("gone"))


@query(with_tables("SELECT namespace, topic_key, id FROM live WHERE topic_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY namespace, topic_key ORDER BY created DESC, id DESC) = 1"))
def latest_by_key(spark, sf_dir):
    return E.latest_by_key(entries(spark, sf_dir)).select("namespace", "topic_key", "id")


@query(with_tables("SELECT id, topic_key FROM live WHERE starts_with(topic_key, 'topic:1')"))
def prefix_scan(spark, sf_dir):
    return E.by_prefix(entries(spark, sf_dir), "topic:1").select("id", "topic_key")


@query(with_tables("SELECT id, type, created FROM live WHERE namespace = 'src0' AND type = 'note' ORDER BY created DESC, id LIMIT 20 OFFSET 2"))
def filtered_page(spark, sf_dir):
    return E.page(entries(spark, sf_dir), "src0", "note", limit=20, offset=2).select("id", "type", F.unix_seconds("created_at").alias("created"))


@query(with_tables("SELECT id FROM live WHERE list_has_all([type, author, source], ['note', 'en'])"))
def all_tags(spark, sf_dir):
    tagged = E.live(entries(spark, sf_dir)).withColumn("tags", F.array("type", "author", "source"))
    return tagged.where(E.has_all_tags(F.col("tags"), ["note", "en"])).select("id")


@query(with_tables("SELECT id, author FROM (SELECT * FROM live WHERE namespace = 'src2' ORDER BY created DESC, id LIMIT 30) WHERE contains(lower(author), 'f')"))
def author_of_page(spark, sf_dir):
    return E.by_author(E.page(entries(spark, sf_dir), "src2", limit=30), "F").select("id", "author")


@query(with_tables("""SELECT r.id, r.created FROM (SELECT e.* FROM live e JOIN live c ON c.id = 12 AND e.namespace = c.namespace ORDER BY e.created DESC, e.id LIMIT 50) r
  JOIN live c ON c.id = 12 WHERE r.created BETWEEN c.created - 2592000 AND c.created + 2592000"""))
def timeline(spark, sf_dir):
    return E.timeline(entries(spark, sf_dir), 12, hours=720).select("id", F.unix_seconds("created_at").alias("created"))


@query(with_tables(f"SELECT id FROM live WHERE source = 'scout' AND NOT verified AND access_count = 0 AND accessed IS NULL AND created < {CUTOFF}"))
def stale_candidates(spark, sf_dir):
    return E.never_used(entries(spark, sf_dir), at(CUTOFF)).select("id")


@query(with_tables(f"SELECT id FROM live WHERE layer = 4 AND NOT verified AND access_count = 0 AND confidence < 0.6 AND coalesce(accessed, created) < {CUTOFF}"))
def evict_candidates(spark, sf_dir):
    return E.evictable(entries(spark, sf_dir), at(CUTOFF), 0.6).select("id")


@query(with_tables(f"SELECT id, deleted FROM entries WHERE deleted < {CUTOFF}"))
def purge_candidates(spark, sf_dir):
    return E.purgeable(entries(spark, sf_dir), at(CUTOFF)).select("id", F.unix_seconds("deleted_at").alias("deleted"))


@query(with_tables(f"SELECT id, {HASH} AS content_hash FROM entries"))
def content_hash(spark, sf_dir):
    return entries(spark, sf_dir).select("id", T.content_hash(F.col("title"), F.col("content")).alias("content_hash"))


@query(with_tables(f"SELECT * FROM (SELECT id, namespace, {HASH} AS hash, count(*) OVER (PARTITION BY namespace, {HASH}) AS copies FROM live) WHERE copies > 1"))
def duplicate_groups(spark, sf_dir):
    return E.duplicate_groups(entries(spark, sf_dir)).select("id", "namespace", "hash", "copies")


@query(with_tables(f"""SELECT id, first_value(id) OVER (PARTITION BY namespace, h ORDER BY access_count DESC, verified DESC, created DESC, id) AS keep_id
  FROM (SELECT *, {HASH} AS h, count(*) OVER (PARTITION BY namespace, {HASH}) AS c FROM live) WHERE c > 1"""))
def duplicate_keepers(spark, sf_dir):
    return E.keepers(entries(spark, sf_dir))


@query(with_tables(f"""
  SELECT id, CASE WHEN copy THEN 'duplicate' WHEN prev IS NULL THEN 'created' ELSE 'updated' END AS action, CASE WHEN NOT copy THEN prev END AS supersedes FROM (
    SELECT *, CASE WHEN topic_key IS NOT NULL THEN lag(id) OVER (PARTITION BY namespace, topic_key, copy AND batch = 1 ORDER BY batch, t, id) END AS prev FROM (
      SELECT *, row_number() OVER (PARTITION BY namespace, h ORDER BY batch, t, id) > 1 AS copy FROM (
        SELECT id, namespace, topic_key, {HASH} AS h, created AS t, 0 AS batch FROM live WHERE id % 2 = 0 OR id % 3 = 0
        UNION ALL SELECT id, namespace, topic_key, {HASH}, {NOW}, 1 FROM live WHERE NOT (id % 2 = 0 OR id % 3 = 0) OR id % 12 = 0)))
  WHERE batch = 1"""))
def save_batch(spark, sf_dir):
    rows = E.live(entries(spark, sf_dir))
    return E.saved(rows.where("not (id % 2 = 0 or id % 3 = 0) or id % 12 = 0"), rows.where("id % 2 = 0 or id % 3 = 0"), now())


@query(with_tables(f"""SELECT id, access_count + CASE WHEN id % 4 = 0 AND deleted IS NULL THEN 1 ELSE 0 END AS access_count,
  CASE WHEN id % 4 = 0 AND deleted IS NULL THEN {NOW} ELSE accessed END AS accessed, CASE WHEN id % 4 = 0 AND deleted IS NULL THEN least(layer, 2) ELSE layer END AS layer FROM entries"""))
def touch(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return E.touched(rows, rows.where("id % 4 = 0"), now()).select("id", "access_count", F.unix_seconds("last_accessed_at").alias("accessed"), "layer")


@query(with_tables(f"SELECT id, CASE WHEN id % 6 = 0 THEN 'new' ELSE title END AS title, layer, CASE WHEN id % 6 = 0 THEN {NOW} ELSE updated END AS updated FROM entries"))
def patch(spark, sf_dir):
    rows = entries(spark, sf_dir)
    patches = rows.where("id % 6 = 0").select("id", F.lit("new").alias("title"), F.lit(None).cast("int").alias("layer"))
    return E.patched(rows, patches, now()).select("id", "title", "layer", F.unix_seconds("updated_at").alias("updated"))


@query(with_tables("SELECT CASE WHEN namespace = 'src3' AND deleted IS NULL THEN 'src4' ELSE namespace END AS namespace, count(*) AS n FROM entries GROUP BY 1"))
def merge_namespaces(spark, sf_dir):
    return E.namespaces_merged(entries(spark, sf_dir), "src3", "src4").groupBy("namespace").agg(F.count("*").alias("n"))


DECAY = f"greatest(0, least(1, (CASE WHEN layer = 4 THEN 0.5 ELSE 1 END) * exp(-0.05 * (greatest(0, {NOW} - coalesce(accessed, created)) / 86400.0::DOUBLE)) + least(0.05 * access_count::DOUBLE, 0.5)))"


@query(with_tables(f"SELECT id, round({DECAY}, 6) AS decay FROM live"))
def decay(spark, sf_dir):
    return E.live(entries(spark, sf_dir)).select("id", F.round(R.decay(now()), 6).alias("decay"))


@query(with_tables(f"""SELECT id, layer, n AS next_layer FROM (SELECT id, layer,
  CASE WHEN verified AND layer = 1 THEN 3 WHEN access_count >= 5 AND layer < 3 THEN layer + 1
       WHEN confidence < 0.5 AND layer < 4 AND d >= 2 * lim THEN 4 WHEN d >= lim THEN layer + 1 END AS n
  FROM (SELECT *, greatest(0, {NOW} - coalesce(accessed, created)) // 86400 AS d, CASE layer WHEN 1 THEN 7 WHEN 2 THEN 14 WHEN 3 THEN 30 END AS lim FROM live)) WHERE n <> layer"""))
def layer_transitions(spark, sf_dir):
    return E.transitions(entries(spark, sf_dir), now(), newest=None)


@query(with_tables("""SELECT coalesce(e.namespace, s.namespace) AS namespace, coalesce(e.n, 0) AS entries, coalesce(s.n, 0) AS sessions
  FROM (SELECT namespace, count(*) n FROM live GROUP BY 1) e FULL JOIN (SELECT concat('src', conv_id % 30) AS namespace, count(DISTINCT conv_id) n FROM conversations GROUP BY 1) s ON e.namespace = s.namespace"""))
def namespace_stats(spark, sf_dir):
    sessions = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.concat(F.lit("src"), F.col("conv_id") % 30).alias("namespace"))
    return S.by_namespace(entries(spark, sf_dir), sessions)


@query(with_tables("""SELECT 'type' AS facet, type AS value, count(*) AS entries FROM live GROUP BY 2 UNION ALL SELECT 'layer', layer::VARCHAR, count(*) FROM live GROUP BY 2
  UNION ALL SELECT 'namespace', namespace, count(*) FROM live GROUP BY 2"""))
def live_breakdown(spark, sf_dir):
    return S.breakdown(entries(spark, sf_dir))


@query(with_tables("""SELECT type, count(*) AS entries, string_agg(title, ' | ' ORDER BY created DESC, id) FILTER (k <= 5) AS titles FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY created DESC, id) AS k FROM (SELECT * FROM live ORDER BY created DESC, id LIMIT 100)) GROUP BY type"""))
def topics(spark, sf_dir):
    return S.topics(entries(spark, sf_dir))


@query("""SELECT event_type, min(CASE WHEN u >= ceil(n * 50 / 100.0) THEN value END) AS p50, min(CASE WHEN u >= ceil(n * 95 / 100.0) THEN value END) AS p95 FROM (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS u, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")
def nearest_rank(spark, sf_dir):
    return S.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", [50, 95])


@query("""SELECT user_id, event_type, n AS uses, files FROM (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2) JOIN (
  SELECT user_id, event_type, string_agg(f, ',' ORDER BY f) AS files FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY f) k FROM (
    SELECT DISTINCT user_id, event_type, 'f' || (event_id % 40) AS f FROM events)) WHERE k <= 10 GROUP BY 1, 2) USING (user_id, event_type)""")
def tool_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("f", F.concat(F.lit("f"), F.col("event_id") % 40))
    return S.tool_usage(rows, "user_id", "event_type", "f")


@query("""SELECT plan, count(*) FILTER (done) AS done, count(*) AS total FROM (
  SELECT o_custkey AS plan, o_orderpriority AS phase, bool_and(o_orderstatus = 'F') AS done FROM orders GROUP BY 1, 2) GROUP BY 1""")
def phase_progress(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderpriority").alias("phase"), (F.col("o_orderstatus") == "F").alias("done"))
    return S.phase_progress(parts)


@query("""WITH c AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS module, count(*) AS n FROM pages GROUP BY 1), b AS (SELECT * FROM c ORDER BY n DESC, module LIMIT 5)
  SELECT module, n::BIGINT AS n FROM b UNION ALL SELECT '(other)', sum(n)::BIGINT FROM c WHERE module NOT IN (SELECT module FROM b) HAVING sum(n) IS NOT NULL""")
def module_sizes(spark, sf_dir):
    counts = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("module")).agg(F.count("*").alias("n"))
    return S.top_and_rest(counts, "module", "n", 5)


@query("""SELECT 'status' AS facet, s AS value, count(*) AS n FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'indexed' WHEN 1 THEN 'partial' ELSE 'skipped_lang' END AS s FROM pages) GROUP BY 2
  UNION ALL (SELECT 'skipped', coalesce(nullif(regexp_extract(url, '\\.([^./]+)$', 1), ''), '(no extension)') AS e, count(*) AS n FROM pages WHERE page_id % 3 = 2 GROUP BY 2 ORDER BY n DESC, e LIMIT 8)""")
def coverage(spark, sf_dir):
    status = F.when(F.col("page_id") % 3 == 0, "indexed").when(F.col("page_id") % 3 == 1, "partial").otherwise("skipped_lang")
    return S.coverage(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), status.alias("status")))


@query(with_tables("SELECT sum(ceil(length(content) / 4.0))::BIGINT AS tokens, count(*) AS rows FROM live"))
def token_budget(spark, sf_dir):
    return S.result_tokens(E.live(entries(spark, sf_dir)), F.col("content"))


@query(with_tables("SELECT op_kind AS trait, count(DISTINCT entry_id % 7) AS files FROM changes GROUP BY 1 HAVING count(DISTINCT entry_id % 7) >= 2"))
def impl_groups(spark, sf_dir):
    return S.impl_groups(changes(spark, sf_dir).select(F.col("op_kind").alias("trait"), (F.col("entry_id") % 7).alias("file")))

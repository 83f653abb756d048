"""Writes, sessions, queues and change sets over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import entries as E
from tessera.operators import lifecycle as L
from tessera.operators import stats as S
from tessera.operators.search import NOT_INJECTED

from .entry_queries import HASH, at
from .registry import query
from .tables import NOW, changes, edges, entries, now, sessions, table, tagged_entries, with_tables


@query(with_tables("SELECT id, access_count + CASE WHEN id % 5 = 0 AND deleted IS NULL THEN 1 ELSE 0 END AS injected_count, updated FROM entries"))
def mark_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumn("injected_count", F.col("access_count"))
    return L.injected(rows, rows.where("id % 5 = 0"), now()).select("id", "injected_count", F.unix_seconds("updated_at").alias("updated"))


@query(with_tables(f"SELECT id, verified OR (id % 4 = 1 AND deleted IS NULL) AS verified, CASE WHEN id % 4 = 1 AND deleted IS NULL THEN 'me' END AS verified_by, CASE WHEN id % 4 = 1 AND deleted IS NULL THEN {NOW} END AS verified_at FROM entries"))
def mark_verified(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return L.verified(rows, rows.where("id % 4 = 1"), "me", now()).select("id", "verified", "verified_by", F.unix_seconds("verified_at").alias("verified_at"))


@query(with_tables("SELECT id, CASE WHEN id % 3 = 0 THEN 'new,' || type ELSE author || ',' || source || ',' || namespace || '.rs' END AS tags FROM entries"))
def retag(spark, sf_dir):
    rows = tagged_entries(spark, sf_dir)
    got = L.retagged(rows, rows.where("id % 3 = 0").select("id", F.array(F.lit("new"), "type").alias("tags")))
    return got.select("id", F.array_join("tags", ",").alias("tags"))


@query(with_tables(f"SELECT id AS entry_id, 'delete' AS op_kind, {NOW} AS created FROM live WHERE id % 6 = 1"))
def deprecate_log(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return L.deprecated(rows, rows.where("id % 6 = 1"), now())[1].select("entry_id", "op_kind", F.unix_seconds("created_at").alias("created"))


@query(with_tables(f"SELECT id, CASE WHEN id % 6 = 1 AND deleted IS NULL THEN {NOW} ELSE deleted END AS deleted FROM entries"))
def deprecate(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return L.deprecated(rows, rows.where("id % 6 = 1"), now())[0].select("id", F.unix_seconds("deleted_at").alias("deleted"))


def _purged(spark, sf_dir):
    rows, vectors = entries(spark, sf_dir), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return L.purged(rows, edges(spark, sf_dir), vectors, E.purgeable(rows, at(1707955200)))


@query(with_tables("SELECT from_id, to_id, type FROM edges WHERE from_id NOT IN (SELECT id FROM entries WHERE deleted < 1707955200) AND to_id NOT IN (SELECT id FROM entries WHERE deleted < 1707955200)"))
def purge_cascade_edges(spark, sf_dir):
    return _purged(spark, sf_dir)[1].select("from_id", "to_id", "type")


@query(with_tables("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM entries WHERE deleted < 1707955200)"))
def purge_cascade_vectors(spark, sf_dir):
    return _purged(spark, sf_dir)[2].select("id")


@query(with_tables("SELECT id FROM entries WHERE deleted IS NULL OR deleted >= 1707955200"))
def purge(spark, sf_dir):
    return _purged(spark, sf_dir)[0].select("id")


@query(with_tables(f"SELECT id, CASE WHEN deleted IS NULL AND layer = 4 AND NOT verified AND access_count = 0 AND confidence < 0.6 AND coalesce(accessed, created) < 1707955200 THEN {NOW} ELSE deleted END AS deleted FROM entries"))
def evict(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return L.evicted(rows, E.evictable(rows, at(1707955200), 0.6), now()).select("id", F.unix_seconds("deleted_at").alias("deleted"))


@query(with_tables(f"SELECT id FROM changes WHERE created >= {NOW} - 70 * 86400"))
def prune_log(spark, sf_dir):
    return L.pruned(changes(spark, sf_dir), now(), 70).select("id")


@query(with_tables("SELECT from_id, to_id, type, CASE WHEN from_id % 4 = 0 THEN 0.05 ELSE strength END::DOUBLE AS strength FROM edges UNION ALL SELECT from_id, to_id + 1, 'related', 0.05 FROM edges WHERE from_id % 4 = 0 AND NOT (type = 'related' AND to_id + 1 = to_id)"))
def save_edges(spark, sf_dir):
    old = edges(spark, sf_dir)
    some = old.where("from_id % 4 = 0").withColumn("strength", F.lit(0.05))
    return L.edges_saved(old, some.union(some.withColumn("to_id", F.col("to_id") + 1).withColumn("type", F.lit("related"))))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE len(embedding) END AS n FROM embeddings")
def upsert_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return L.vectors_saved(v, v.where("id % 3 = 0").withColumn("embedding", F.array(F.lit(1.0).cast("float")))).select("id", F.size("embedding").alias("n"))


@query(with_tables("SELECT a.id AS asked, from_id, to_id, type, strength FROM edges JOIN (SELECT id FROM entries WHERE id % 10 = 0) a ON a.id = from_id OR a.id = to_id"))
def entry_edges(spark, sf_dir):
    return L.neighbour_edges(edges(spark, sf_dir), entries(spark, sf_dir).where("id % 10 = 0"))


@query(with_tables("SELECT a.id AS asked, from_id, to_id, type, strength FROM edges JOIN (SELECT id FROM entries WHERE id % 10 = 0) a ON a.id = to_id"))
def entry_edges_to(spark, sf_dir):
    return L.neighbour_edges(edges(spark, sf_dir), entries(spark, sf_dir).where("id % 10 = 0"), "to")


@query(with_tables("SELECT id, namespace, len(embedding) AS dim FROM live JOIN embeddings ON vec_id = id"))
def embedded_entries(spark, sf_dir):
    """Live entries with their vectors."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return E.live(entries(spark, sf_dir)).join(vectors, "id").select("id", "namespace", F.size("embedding").alias("dim"))


@query(with_tables(f"SELECT id, {HASH} AS content_hash FROM entries WHERE id % 2 = 0 ORDER BY created, id LIMIT 300"))
def hash_backfill(spark, sf_dir):
    rows = entries(spark, sf_dir).withColumn("content_hash", F.when(F.col("id") % 2 == 1, "known"))
    return L.rehashed(rows, 300)


PLAIN = "trim(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'))"
BATCH = """SELECT id, namespace, title, topic_key, created, CASE WHEN id % 6 = 1 THEN content || ' <private>' || content ELSE content END AS given,
  CASE WHEN length(c) > 10000 THEN substr(c, 1, (10000 - length(m))::BIGINT) || m ELSE c END AS content, deleted, length(c) AS n FROM (
  SELECT *, chr(10) || chr(10) || '… [truncated ' || (length(c) - 10000) || ' chars]' AS m FROM (
    SELECT *, CASE WHEN id % 6 = 1 THEN content || ' [redacted]' WHEN id % 6 = 3 THEN '[REDACTED:npm-token] ' || content ELSE content END AS c FROM live WHERE id % 2 = 1))"""


def _proposed(spark, sf_dir, key=None):
    rows = tagged_entries(spark, sf_dir).where("deleted_at is null")
    rows = rows if key is None else rows.withColumn("topic_key", key)
    given = F.when(F.col("id") % 6 == 1, F.concat("content", F.lit(" <private>"), "content"))
    given = given.when(F.col("id") % 6 == 3, F.concat(F.lit("npm" + "_" + "b2" * 18 + " "), "content")).otherwise(F.col("content"))
    return L.proposed(rows.where(F.col("id") % 2 == 1).withColumn("content", given), rows.where("id % 2 = 0"), now())


@query(with_tables(f"""WITH b AS ({BATCH}), every AS (SELECT id, namespace, topic_key, {HASH} AS h, created AS t, 0 AS batch FROM live WHERE id % 2 = 0
    UNION ALL SELECT id, namespace, topic_key, {HASH}, {NOW}, 1 FROM b)
  SELECT q.id, action, length(b.content) AS n FROM (SELECT id, CASE WHEN copy THEN 'duplicate' WHEN prev IS NULL THEN 'created' ELSE 'updated' END AS action FROM (
    SELECT *, CASE WHEN topic_key IS NOT NULL THEN lag(id) OVER (PARTITION BY namespace, topic_key, copy AND batch = 1 ORDER BY batch, t, id) END AS prev FROM (
      SELECT *, row_number() OVER (PARTITION BY namespace, h ORDER BY batch, t, id) > 1 AS copy FROM every)) WHERE batch = 1) q JOIN b USING (id)"""))
def propose(spark, sf_dir):
    return _proposed(spark, sf_dir)[0].select("id", "action", F.length("content").alias("n"))


@query(with_tables(f"""WITH b AS ({BATCH}), every AS (SELECT id, namespace, 't' || (id % 3) AS topic_key, {HASH} AS h, created AS t, 0 AS batch FROM live WHERE id % 2 = 0
    UNION ALL SELECT id, namespace, 't' || (id % 3), {HASH}, {NOW}, 1 FROM b)
  SELECT id AS from_id, prev AS to_id, 'supersedes' AS type FROM (SELECT *, lag(id) OVER (PARTITION BY namespace, topic_key, copy AND batch = 1 ORDER BY batch, t, id) AS prev FROM (
    SELECT *, row_number() OVER (PARTITION BY namespace, h ORDER BY batch, t, id) > 1 AS copy FROM every)) WHERE batch = 1 AND NOT copy AND prev IS NOT NULL"""))
def propose_edges(spark, sf_dir):
    """Supersedes edges of a proposed batch in which every row has a key."""
    return _proposed(spark, sf_dir, F.concat(F.lit("t"), F.col("id") % 3))[1].select("from_id", "to_id", "type")


def leaking(spark, sf_dir):
    """Entries of which every fifth has a password behind its whole text."""
    said = F.when(F.col("id") % 5 == 0, F.concat("content", F.lit(" password="), F.lit("hunter22x"))).otherwise(F.col("content"))
    return entries(spark, sf_dir).withColumn("content", said)


@query(with_tables("SELECT id, md5(content || ' password=[REDACTED:keyed-secret]') AS digest, 1 AS hits, 40 > strlen(content) + 19 AS heavy FROM entries WHERE id % 5 = 0 AND content IS NOT NULL"))
def scrub(spark, sf_dir):
    return L.scrubbed(leaking(spark, sf_dir)).select("id", F.md5("content").alias("digest"), "hits", "heavy")


@query(with_tables("""SELECT namespace, id FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY started DESC, id) AS k FROM sessions) WHERE k <= 10 AND status = 'active'
  QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY k) = 1"""))
def active_session(spark, sf_dir):
    return L.active_sessions(sessions(spark, sf_dir))


@query(with_tables(f"SELECT id, CASE WHEN id % 7 = 0 THEN 'done' ELSE goal END AS goal, CASE WHEN id % 7 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN id % 7 = 0 OR status IN ('completed', 'abandoned') THEN {NOW} END AS ended FROM sessions"))
def end_sessions(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    updates = rows.where("id % 7 = 0").select("id", F.lit("done").alias("goal"), F.lit("completed").alias("status"))
    return L.sessions_updated(rows, updates, now()).select("id", "goal", "status", F.unix_seconds("ended_at").alias("ended"))


@query(with_tables(f"""SELECT id, m AS minutes, 'Auto-expired after ' || m || ' minutes of inactivity. ' || CASE WHEN n IS NULL THEN 'No file changes were tracked.' ELSE n || ' file(s) modified: ' || f || '.' END AS summary FROM (
  SELECT id, CAST(floor(({NOW} - coalesce(last, started)) / 60) AS BIGINT) AS m, n, f FROM sessions LEFT JOIN (
    SELECT l_orderkey AS id, min(1704067200 + l_orderkey * 60) AS last, count(*) AS n, string_agg('f' || l_linenumber, ', ' ORDER BY l_linenumber) FILTER (k <= 5) AS f FROM (
      SELECT DISTINCT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) GROUP BY 1) USING (id) WHERE status = 'active') WHERE m > 60000"""))
def expired_sessions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber").distinct()
    files = F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda k: F.concat(F.lit("f"), k))
    activity = lines.groupBy("id").agg(files.alias("files")).withColumn("last_activity", F.timestamp_seconds(1704067200 + F.col("id") * 60))
    return L.expired(sessions(spark, sf_dir), activity, now(), idle_minutes=60000)


@query(f"""WITH p AS (SELECT conv_id AS session, turn AS id, text, substr(sha256(chr(10) || {PLAIN.format("substr(text, 1, 120)")}), 1, 16) AS topic_key FROM conversations)
  SELECT session, topic_key, max(id) AS id, count(*) - 1 AS superseded, (SELECT substr(min_by(text, id), 1, 120) FROM p q WHERE q.session = p.session) AS goal FROM p GROUP BY session, topic_key""")
def captured_prompts(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), F.col("turn").alias("at"), "text")
    return L.captured_prompts(said)


@query(with_tables("SELECT id, '## Session ' || id || ' (' || status || ')' || chr(10) || '**Goal:** ' || goal || CASE WHEN summary IS NOT NULL THEN chr(10) || '**Summary:** ' || summary ELSE '' END AS page FROM sessions"))
def session_pages(spark, sf_dir):
    return L.session_page(sessions(spark, sf_dir))


@query(with_tables("""SELECT namespace, 'entry' AS kind, id, row_number() OVER (PARTITION BY namespace ORDER BY k) AS nth FROM (
    SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created DESC, id) AS k FROM live) WHERE k <= 128 AND type NOT IN ('user-prompt', 'session', 'plan', 'icebox') QUALIFY nth <= 32
  UNION ALL SELECT namespace, 'session', id, row_number() OVER (PARTITION BY namespace ORDER BY k) AS nth FROM (
    SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY started DESC, id) AS k FROM sessions) WHERE k <= 6 AND status = 'completed' QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY k) <= 3"""))
def context_packets(spark, sf_dir):
    return L.context_packet(entries(spark, sf_dir), sessions(spark, sf_dir), NOT_INJECTED)


@query(with_tables("SELECT id, CASE WHEN confirmed IS NULL AND claimed < 1704067200 + 5000 THEN NULL ELSE claimed END AS claimed FROM changes"))
def stale_claims(spark, sf_dir):
    got = L.stale_claims_released(changes(spark, sf_dir), at(1704067200 + 5900), 900)
    return got.select("id", F.unix_seconds("claimed_at").alias("claimed"))


@query(with_tables("SELECT id FROM changes WHERE confirmed IS NULL OR confirmed >= 1704067200 + 2000"))
def outbox_retention(spark, sf_dir):
    return L.retained(changes(spark, sf_dir), at(1704067200 + 2000 + 7 * 86400)).select("id")


@query(with_tables("""SELECT entry_id, arg_max(id, (created, -id)) AS id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM (
  SELECT * FROM changes WHERE confirmed IS NULL AND (claimed IS NULL OR claimed < 1704067200 + 5000) ORDER BY created, id LIMIT 100) GROUP BY 1"""))
def push_batch(spark, sf_dir):
    got = L.pushed(changes(spark, sf_dir), at(1704067200 + 5900))
    return got.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


OUTCOME = "CASE event_id % 6 WHEN 0 THEN 'settled' WHEN 1 THEN 'blocked' WHEN 2 THEN 'transient' WHEN 3 THEN 'error' WHEN 4 THEN 'skipped' ELSE 'done' END"


@query(f"""SELECT event_id, event_id * 1000 + CASE o WHEN 'settled' THEN 3600000 WHEN 'blocked' THEN 600000 WHEN 'transient' THEN 30000 WHEN 'error' THEN 300000 ELSE greatest(30000, least(600000, 20 * ((event_id * 37) % 50000))) END AS not_before
  FROM (SELECT event_id, {OUTCOME} AS o FROM events)""")
def debounce(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 1000).alias("ended_ms"), (F.col("event_id") * 37 % 50000).alias("duration_ms"), F.expr(OUTCOME).alias("outcome"))
    return L.next_allowed(runs).select("event_id", F.col("not_before_ms").alias("not_before"))


@query("""WITH g AS (SELECT page_id AS path, CASE page_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END AS change FROM pages WHERE page_id % 4 < 3),
  h AS (SELECT page_id AS path, CASE page_id % 3 WHEN 0 THEN 'added' ELSE 'modified' END AS change FROM pages WHERE page_id % 5 = 0),
  r AS (SELECT page_id AS source, page_id + 2 AS target FROM pages WHERE page_id % 12 = 2), b AS (SELECT * FROM g UNION SELECT * FROM h)
  SELECT path, change FROM b WHERE (change = 'added' AND path NOT IN (SELECT target FROM r)) OR (change = 'deleted' AND path NOT IN (SELECT source FROM r))
    OR (change = 'modified' AND path NOT IN (SELECT path FROM b WHERE change = 'added' AND path NOT IN (SELECT target FROM r)))
  UNION ALL SELECT target, 'renamed' FROM r""")
def merged_changes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"))
    k = F.col("path") % 4
    listed = p.where("path % 4 < 3").withColumn("change", F.when(k == 0, "added").when(k == 1, "modified").otherwise("deleted"))
    hashed = p.where("path % 5 = 0").withColumn("change", F.when(F.col("path") % 3 == 0, "added").otherwise("modified"))
    return L.merged_changes(listed, hashed, p.where("path % 12 = 2").select(F.col("path").alias("source"), (F.col("path") + 2).alias("target")))


@query("SELECT DISTINCT o_custkey AS plan, o_orderkey AS key FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 2 = 1")
def retired_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("key"))
    return L.retired(o, o.where("key % 2 = 0"), o.where("plan % 3 = 0"))


@query("""SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY t, r, id) AS nth FROM (
  SELECT l_suppkey AS question, l_partkey AS id, min((l_linenumber, l_orderkey)) AS x, x[1] AS t, x[2] AS r FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1, 2)
  QUALIFY nth <= 10""")
def supporting_hits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("question"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("term_no"), F.col("l_orderkey").alias("rank"))
    return L.supporting(li.where("term_no = 1"), li)


@query("SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 2 = 0 AND page_id % 10 = 4 THEN 'new' ELSE 'old' END AS hash FROM pages UNION ALL SELECT 'src/' || page_id, 'new' FROM pages WHERE page_id % 3 = 0")
def focused_crawl(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    before = p.select(F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 10 == 4, "new").otherwise("old").alias("hash"))
    seen = p.where("page_id % 3 = 0").select(F.concat(F.lit("src/"), "page_id").alias("path"), F.lit("new").alias("hash"))
    return L.crawl_state(before, seen, focus="src/")


@query("SELECT url AS path FROM pages WHERE starts_with(url, 'http://') AND contains(url, '/fr/') ")
def subtree(spark, sf_dir):
    host = F.regexp_extract("url", "^([a-z]+://[^/]+)/fr/", 1)
    return table(spark, sf_dir, "pages").where(F.col("url").startswith("http://") & (host != "") & L.in_subtree(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), "fr")).select(F.col("url").alias("path"))


@query(with_tables("SELECT 'p' || (source % 5) AS project, 'f' || (source % 97) AS file_path, target, line FROM calls WHERE source % 97 <> 7 UNION ALL SELECT 'p' || (source % 5), 'f7', 0, 1 FROM calls WHERE source % 97 = 7 AND line = 1"))
def replaced_facts(spark, sf_dir):
    from .graph_queries import calls

    facts = calls(spark, sf_dir).select(F.concat(F.lit("p"), F.col("source") % 5).alias("project"), F.concat(F.lit("f"), F.col("source") % 97).alias("file_path"), "target", "line")
    return L.facts_replaced(facts, facts.where("file_path = 'f7' and line = 1").withColumn("target", F.lit(0).cast("long")))


@query(with_tables("SELECT coalesce(a.namespace, b.namespace) AS namespace, coalesce(a.n, 0) AS entries, coalesce(b.n, 0) AS sessions FROM (SELECT namespace, count(*) n FROM live WHERE namespace IN ('src3', 'src4') GROUP BY 1) a FULL JOIN (SELECT namespace, count(*) n FROM sessions WHERE namespace IN ('src3', 'src4') GROUP BY 1) b ON a.namespace = b.namespace"))
def merge_preview(spark, sf_dir):
    return E.merge_preview(entries(spark, sf_dir), sessions(spark, sf_dir), "src3", "src4")


@query(with_tables("SELECT CASE WHEN namespace = 'src3' THEN 'src4' ELSE namespace END AS namespace, count(*) AS n FROM sessions GROUP BY 1"))
def merge_sessions(spark, sf_dir):
    return E.namespaces_merged(sessions(spark, sf_dir).drop("ended_at"), "src3", "src4").groupBy("namespace").agg(F.count("*").alias("n"))


@query(with_tables("SELECT id, entry_id FROM changes WHERE op_kind = 'error' AND created >= 1705000000 ORDER BY created DESC, id DESC LIMIT 20"))
def debug_log(spark, sf_dir):
    log = changes(spark, sf_dir).withColumnRenamed("op_kind", "event")
    return S.recent_events(log, "error", since=at(1705000000)).select("id", "entry_id")


@query(with_tables("""SELECT id FROM (SELECT id, id % 5 <> 0 AND ((deleted IS NOT NULL AND NOT id % 13 = 0) OR ((deleted IS NOT NULL) = (id % 13 = 0) AND verified AND NOT id % 4 = 0)) AS audited, updated FROM entries)
  WHERE audited ORDER BY updated DESC, id DESC LIMIT 25"""))
def conflict_list(spark, sf_dir):
    from .change_queries import conflicts

    found = conflicts(spark, sf_dir).where("audited").join(entries(spark, sf_dir).select("id", F.col("updated_at").alias("created_at")), "id")
    return S.recent_events(found, limit=25).select("id")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 = 0 THEN 'unknown' WHEN event_id % 4 <> event_id % 2 OR event_id % 8 > 3 THEN 'stale' ELSE 'fresh' END AS verdict FROM events")
def index_freshness(spark, sf_dir):
    k = F.col("event_id")
    base = F.when(k % 7 == 0, "no-git").otherwise((k % 4).cast("string"))
    verdict = T.freshness(base, F.when(k % 5 != 0, "d0"), F.when(k % 3 != 0, (k % 2).cast("string")), F.when(k % 8 > 3, "d1").otherwise("d0"))
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"))

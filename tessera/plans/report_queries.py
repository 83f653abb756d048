"""Reports over entries, runs, files and hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markdown as M
from tessera.functions import redact as D
from tessera.functions import text as T
from tessera.operators import entries as E
from tessera.operators import lifecycle as L
from tessera.operators import stats as S

from .lifecycle_queries import OUTCOME, leaking
from .registry import query
from .tables import entries, now, sessions, table, tagged_entries, with_tables


@query(with_tables("""SELECT n AS next_layer, count(*) AS n FROM (SELECT layer, CASE WHEN verified AND layer = 1 THEN 3 WHEN access_count >= 5 AND layer < 3 THEN layer + 1
    WHEN confidence < 0.5 AND layer < 4 AND d >= 2 * lim THEN 4 WHEN d >= lim THEN layer + 1 END AS n
  FROM (SELECT *, greatest(0, 1711929600 - coalesce(accessed, created)) // 86400 AS d, CASE layer WHEN 1 THEN 7 WHEN 2 THEN 14 WHEN 3 THEN 30 END AS lim FROM live)) WHERE n <> layer GROUP BY 1"""))
def transition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.transition_totals(E.transitions(entries(spark, sf_dir), now(), newest=None))


@query(f"SELECT user_id, count(*) AS runs, count(*) FILTER (o = 'done') * 100 // count(*) AS work_pct, count(*) FILTER (o = 'error') * 100 // count(*) AS error_pct FROM (SELECT user_id, {OUTCOME} AS o FROM events) GROUP BY 1")
def work_rates(spark, sf_dir):
    return S.work_rates(table(spark, sf_dir, "events").select("user_id", F.expr(OUTCOME).alias("outcome")), ["user_id"])


@query(f"SELECT event_type AS reason, count(*) AS n FROM events WHERE {OUTCOME} = 'skipped' GROUP BY 1")
def skip_reasons(spark, sf_dir):
    return S.skip_reasons(table(spark, sf_dir, "events").select(F.expr(OUTCOME).alias("outcome"), F.col("event_type").alias("reason")))


@query("""SELECT count(*) FILTER (e) AS emissions, coalesce(sum(event_id % 700) FILTER (e), 0)::BIGINT AS total_bytes, count(DISTINCT user_id) FILTER (e) AS sessions, count(*) AS fires,
  count(*) FILTER (e) * 100 // count(*) AS hit_rate, coalesce(sum(event_id % 700) FILTER (e), 0)::BIGINT // count(DISTINCT user_id) FILTER (e) AS bytes_per_session FROM (SELECT *, event_id % 3 > 0 AS e FROM events)""")
def hint_stats(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.when(F.col("event_id") % 3 > 0, "emit").otherwise("gated").alias("kind"), (F.col("event_id") % 700).alias("bytes"))
    return S.hint_stats(log)


@query("""WITH r AS (SELECT event_type AS category, event_id % 101 AS score, (event_id % 10) / 10.0::DOUBLE AS confidence, event_id % 4 > 0 AS a, value AS ms FROM events)
  SELECT category, count(*) AS questions, count(*) FILTER (a) AS answered, round(avg(score), 4) AS score, round(avg(confidence), 4) AS confidence, round(avg(ms), 4) AS ms FROM r GROUP BY GROUPING SETS ((category), ())""")
def benchmark_summary(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (k % 101).alias("score"), (k % 10 / 10.0).alias("confidence"), (k % 4 > 0).alias("has_answer"), F.col("value").alias("ms"))
    return S.benchmark_summary(rows).select("category", "questions", "answered", *(F.round(c, 4).alias(c) for c in ("score", "confidence", "ms")))


@query(with_tables("SELECT 'keyed-secret' AS kind, count(*) AS n FROM entries WHERE id % 5 = 0 AND content IS NOT NULL UNION ALL SELECT '(heavy rows)', count(*) FROM entries WHERE id % 5 = 0 AND 40 > strlen(content) + 19"))
def scrub_report(spark, sf_dir):
    """Kinds of secrets in entries' whole texts."""
    return S.scrub_report(L.scrubbed(leaking(spark, sf_dir)), F.concat(D.hits(F.col("title")), D.hits(F.col("content"))))


@query(with_tables("SELECT namespace, count(*) AS scanned, count(*) FILTER (contains(lower(content), 'the user opened the file')) AS matched FROM (SELECT namespace, type, CASE WHEN id % 3 = 0 THEN 'The user opened the file ' || content ELSE replace(content, chr(10), ' ') END AS content FROM live) WHERE type = 'user-prompt' GROUP BY 1"))
def noise_report(spark, sf_dir):
    said = F.when(F.col("id") % 3 == 0, F.concat(F.lit("The user opened the file "), "content")).otherwise(F.replace("content", F.lit("\n"), F.lit(" ")))
    return S.noise_report(entries(spark, sf_dir).withColumn("content", said), T.is_machine_made(F.col("content")))


@query("SELECT event_id % 50 AS path, count(*) AS n, string_agg(DISTINCT upper(event_type), ',' ORDER BY upper(event_type)) AS kinds FROM events GROUP BY 1")
def debt_by_file(spark, sf_dir):
    return S.debt_by_file(table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("path"), F.upper("event_type").alias("marker")))


@query(with_tables("SELECT CASE WHEN id % 3 = 0 THEN namespace || '.rs' WHEN topic_key IS NOT NULL THEN topic_key ELSE '(unattributed)' END AS place, type, count(*) AS n, min(created) AS oldest FROM live GROUP BY 1, 2"))
def debt_groups(spark, sf_dir):
    rows = tagged_entries(spark, sf_dir)
    tags = F.when(F.col("id") % 3 == 0, F.col("tags")).otherwise(F.array("author"))
    return S.debt_groups(rows.withColumn("tags", tags)).withColumn("oldest", F.unix_seconds("oldest"))


@query(with_tables("SELECT namespace, type, count(*) AS n, max(created) FILTER (type = 'architecture' AND id % 2 = 1) AS last FROM (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY created DESC, id) <= 1000) GROUP BY 1, 2"))
def crawl_status(spark, sf_dir):
    rows = entries(spark, sf_dir).withColumn("title", F.when(F.col("id") % 2 == 1, F.concat(F.lit("Architecture summary of "), "title")).otherwise(F.col("title")))
    return S.crawl_status(rows).select("namespace", "type", "n", F.unix_seconds("last_crawl").alias("last"))


@query("""WITH p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, lower(html) AS h FROM pages),
  f AS (SELECT path, len(string_split(path, '/')) - 1 AS d, coalesce(nullif(regexp_extract(path, '\\.([^./]+)$', 1), ''), '(none)') AS e, contains(h, 'track') AS s FROM p)
  SELECT 'depth' AS facet, CASE WHEN d >= 4 THEN '4+' ELSE d::VARCHAR END AS value, count(*) AS n FROM f GROUP BY 2
  UNION ALL (SELECT 'extension', e, count(*) AS n FROM f GROUP BY 2 ORDER BY n DESC, e LIMIT 5) UNION ALL SELECT 'stack', 'tracking', count(*) FROM f WHERE s HAVING count(*) > 0""")
def architecture_summary(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.array("html").alias("imports"))
    return S.architecture_summary(files, (("tracking", "track"), ("none", "\x01\x02")))


@query("""WITH p AS (SELECT 'p' || (page_id % 12) AS project FROM pages), s AS (SELECT 'p' || (p_partkey % 10) AS project FROM part)
  SELECT p.project, p.n AS n_files, coalesce(s.n, 0) AS n_symbols FROM (SELECT project, count(*) n FROM p GROUP BY 1) p LEFT JOIN (SELECT project, count(*) n FROM s GROUP BY 1) s USING (project)""")
def project_listing(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id") % 12).alias("project"))
    symbols = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey") % 10).alias("project"))
    return S.project_listing(files, files=files, symbols=symbols)


@query("""SELECT conv_id, turn, coalesce(list_aggregate(list_slice(list_filter(regexp_extract_all(q, '[A-Za-z0-9_]+'), lambda w: length(w) >= 5 AND regexp_matches(w, '[A-Za-z]') AND (contains(w, '_') OR (regexp_matches(w, '[a-z]') AND regexp_matches(w, '^.+[A-Z]')))), 1, 4), 'string_agg', ','), '') AS names
  FROM (SELECT conv_id, turn, coalesce(text, '') || ' parseFile' || turn || ' HTTPS snake_case_' || conv_id || ' Plain ABCDE' AS q FROM conversations)""")
def prompt_identifiers(spark, sf_dir):
    q = F.concat(F.coalesce("text", F.lit("")), F.lit(" parseFile"), "turn", F.lit(" HTTPS snake_case_"), "conv_id", F.lit(" Plain ABCDE"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.identifiers(q), ",").alias("names"))


@query("""SELECT page_id, CASE WHEN length(best) >= 4 AND regexp_matches(best, '[A-Za-z]') THEN best END AS token FROM (
  SELECT page_id, first(w ORDER BY length(w) DESC, nth) AS best FROM (SELECT page_id, unnest(l) AS w, generate_subscripts(l, 1) AS nth FROM (SELECT page_id, regexp_extract_all(url, '[A-Za-z0-9_]+') AS l FROM pages)) GROUP BY 1)""")
def hint_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.hint_token(F.col("url")).alias("token"))


@query("SELECT page_id, regexp_replace(html, '[\\x00-\\x1f\\x7f]', ' ', 'g') AS html FROM pages")
def without_controls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.without_controls(F.col("html")).alias("html"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 WHEN 4 THEN least(1, greatest(0, value / 10)) ELSE 0.9 END::DOUBLE AS confidence FROM events")
def confidence_presets(spark, sf_dir):
    k = F.col("event_id") % 6
    said = F.when(k == 0, " Verified").when(k == 1, "observed").when(k == 2, "INFERRED").when(k == 3, "speculative").when(k == 4, (F.col("value") / 10).cast("string")).otherwise("rather sure")
    return table(spark, sf_dir, "events").select("event_id", T.confidence_of(said).alias("confidence"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS value FROM documents")
def tag_values(spark, sf_dir):
    tags = F.array(F.concat(F.lit("x:"), "source"), F.concat(F.when(F.col("doc_id") % 2 == 0, "plan:").otherwise("other:"), "source"), F.concat(F.lit("plan:"), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.tag_value(tags, "plan:").alias("value"))


@query("SELECT doc_id, 2 AS n, 'Part ' || source AS first, 'Second' AS last FROM documents")
def markdown_headings(spark, sf_dir):
    page = F.concat(F.lit("# Part "), "source", F.lit("\n\n"), F.regexp_replace("text", "(?m)^\\s*[#`]", ""), F.lit("\n```\n# not this\n```\n## Second ##\n"))
    found = table(spark, sf_dir, "documents").select("doc_id", M.headings(page).alias("h"))
    return found.select("doc_id", F.size("h").alias("n"), F.col("h")[0]["text"].alias("first"), F.element_at("h", -1)["text"].alias("last"))


@query(with_tables("SELECT coalesce(e.namespace, s.namespace) AS namespace, coalesce(e.n, 0) AS entries, coalesce(s.n, 0) AS sessions FROM (SELECT namespace, count(*) n FROM live GROUP BY 1) e FULL JOIN (SELECT namespace, count(*) n FROM sessions GROUP BY 1) s ON e.namespace = s.namespace"))
def global_stats(spark, sf_dir):
    return S.by_namespace(entries(spark, sf_dir), sessions(spark, sf_dir))

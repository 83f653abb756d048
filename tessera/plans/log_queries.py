"""Logs of growing width and imports with bad lines, written from the events and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.sources.shared import new_folder

from .registry import query
from .tables import derived, table

COLUMNS = [("at", "timestamp"), ("project", "string"), ("outcome", "string"), ("duration_ms", "long"), ("files", "long")]
#: rows of three, four and five columns, some with a project that holds tabs
LOGGED = """SELECT event_id, ts AS at, CASE WHEN event_id % 13 = 0 THEN concat('p', chr(9), CAST(user_id AS STRING)) ELSE concat('p', CAST(user_id AS STRING)) END AS project,
  CASE event_id % 6 WHEN 0 THEN 'spawn' WHEN 1 THEN 'debounce' WHEN 2 THEN 'error: locked' WHEN 3 THEN 'skip: fresh' ELSE 'done' END AS outcome,
  CASE WHEN event_id % 3 > 0 THEN event_id % 977 END AS duration_ms, CASE WHEN event_id % 3 = 2 THEN event_id % 41 END AS files FROM {events}"""
#: lines that other programs left in the log
BROKEN = "SELECT CASE event_id % 5 WHEN 0 THEN 'only one' WHEN 1 THEN concat('2024-01-01 00:00:00', chr(9), 'p1') WHEN 2 THEN concat('yesterday', chr(9), 'p1', chr(9), 'done') WHEN 3 THEN concat('2024-01-01 00:00:00', chr(9), 'late', chr(9), 'done', chr(9), 'many', chr(9), CAST(event_id AS STRING), chr(9), 'more') ELSE '' END AS value FROM {events} WHERE event_id % 7 = 0"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, names = new_folder(spark, "log"), [n for n, _ in COLUMNS]
    rows = derived(spark, sf_dir, LOGGED, "events")
    S.append_log(rows.where("event_id % 2 = 0"), path, names[:3])  # written before the later columns were known
    S.append_log(rows.where("event_id % 2 = 1"), path, names)
    derived(spark, sf_dir, BROKEN, "events").write.mode("append").text(path)
    return S.stats_log(spark, path, COLUMNS)


@query(f"""WITH r AS (SELECT date_trunc('second', "at") AS "at", replace(project, chr(9), ' ') AS project, outcome, CASE WHEN event_id % 2 = 1 THEN duration_ms END AS d, CASE WHEN event_id % 2 = 1 THEN files END AS f FROM ({LOGGED.format(events='events')})),
  a AS (SELECT * FROM r UNION ALL SELECT TIMESTAMP '2024-01-01', 'late', 'done', NULL, event_id FROM events WHERE event_id % 7 = 0 AND event_id % 5 = 3)
  SELECT outcome, count(*) AS n, count(DISTINCT project) AS projects, count(d) AS timed, sum(d)::BIGINT AS duration_ms, sum(f)::BIGINT AS files, epoch(max("at"))::BIGINT AS last FROM a GROUP BY outcome""")
def log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of rows of every width, read in one pass and counted by outcome."""
    sound = _log(spark, sf_dir).where("fault is null")
    return sound.groupBy("outcome").agg(
        F.count("*").alias("n"), F.countDistinct("project").alias("projects"), F.count("duration_ms").alias("timed"), F.sum("duration_ms").alias("duration_ms"),
        F.sum("files").alias("files"), F.unix_seconds(F.max("at")).alias("last"),
    )


@query("""WITH b AS (SELECT event_id % 5 AS k FROM events WHERE event_id % 7 = 0) SELECT CASE WHEN k < 2 THEN 'too few fields' ELSE 'bad at' END AS fault, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS width, count(*) AS n FROM b WHERE k < 3 GROUP BY 1, 2""")
def log_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where("fault is not null").groupBy("fault", "width").agg(F.count("*").alias("n"))


#: tagged lines of every kind, among them broken ones, and the whole text of each document as a value
LINES = """CASE doc_id % 11 WHEN 0 THEN concat('{"kind":"entry","data":{"id":', d, '}}') WHEN 1 THEN concat('{"kind":"memo","data":{"id":', d, '}}') WHEN 2 THEN concat('{"kind":"entry","data":{"id":', d) WHEN 3 THEN '   '
  WHEN 4 THEN concat('[', d, ']') WHEN 5 THEN '{"kind":"edge","data":{"from":1}}' WHEN 6 THEN concat('{"id":', d, '}') WHEN 7 THEN '{"title":"bare"}' WHEN 8 THEN text WHEN 9 THEN concat('{"kind":"session","data":{"id":', d, '}}') ELSE NULL END"""


@query(f"""WITH l AS (SELECT {LINES} AS value FROM (SELECT doc_id, text, doc_id::VARCHAR AS d FROM documents)), f AS (SELECT value, CASE WHEN value IS NULL OR trim(value) = '' THEN 'empty' WHEN NOT json_valid(value) THEN 'no JSON' WHEN json_type(value) <> 'OBJECT' THEN 'no object'
  WHEN json_extract_string(value, '$.kind') NOT IN ('entry', 'edge', 'session') THEN 'unknown kind' WHEN json_extract_string(value, CASE WHEN json_extract_string(value, '$.kind') IS NULL THEN '$.id' ELSE '$.data.id' END) IS NULL THEN 'no id' END AS fault FROM l)
  SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY fault""")
def import_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an import leaves out, by reason; among them whole texts that are no JSON."""
    lines = table(spark, sf_dir, "documents").withColumn("d", F.col("doc_id").cast("string")).select(F.expr(LINES).alias("value"))
    return S.line_faults(lines)

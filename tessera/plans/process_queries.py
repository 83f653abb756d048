"""Sessions as a process over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming.process import AUTOMATIC, session_rows

from .registry import query
from .tables import NOW, derived

ACTIVITY = """SELECT CAST(user_id AS STRING) AS key, ts, event_id, CASE event_id % 23 WHEN 0 THEN 'end' WHEN 1 THEN 'checkpoint' WHEN 2 THEN 'prompt' ELSE 'activity' END AS kind,
  concat(event_type, ' ', CAST(event_id AS STRING)) AS text, CASE WHEN event_id % 3 = 0 THEN concat('f', CAST(event_id % 11 AS STRING)) END AS file FROM {events}"""


@query(f"""WITH e AS (SELECT *, row_number() OVER w AS o, lag(ts) OVER w AS before, lag(kind) OVER w AS was FROM ({ACTIVITY.format(events='events')}) WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
  n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTE OR was = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY o) AS s FROM e),
  g AS (SELECT key, s, min(ts) AS started, max(ts) AS last, max(o) AS last_o, bool_or(kind = 'end') AS ended, max(text) FILTER (kind = 'end') AS said, min(o) FILTER (kind = 'prompt') AS prompt_o, arg_min(text, o) FILTER (kind = 'prompt') AS goal FROM n GROUP BY 1, 2),
  f AS (SELECT key, s, file, min(o) AS o FROM n WHERE file IS NOT NULL GROUP BY 1, 2, 3),
  t AS (SELECT key, s, NULL AS o, 'start' AS "row", started AS "at" FROM g UNION ALL SELECT key, s, o, 'checkpoint', ts FROM n WHERE kind = 'checkpoint'
    UNION ALL SELECT key, s, last_o, 'end', CASE WHEN ended THEN last ELSE last + INTERVAL 30 MINUTE END FROM g WHERE ended OR epoch(last) + 1800 < {NOW}),
  x AS (SELECT t.*, g.started, g.ended, g.said, CASE WHEN g.prompt_o <= t.o THEN g.goal END AS goal, count(f.file) AS n_files, coalesce(list(f.file ORDER BY f.o) FILTER (f.file IS NOT NULL), [])[1:5] AS files FROM t JOIN g USING (key, s) LEFT JOIN f ON f.key = t.key AND f.s = t.s AND f.o <= t.o GROUP BY ALL),
  y AS (SELECT *, CASE WHEN ended THEN said WHEN n_files = 0 THEN 'Auto-expired after 30 minutes of inactivity. No file changes were tracked.' ELSE 'Auto-expired after 30 minutes of inactivity. ' || n_files || ' file(s) modified: ' || array_to_string(files, ', ') || '.' END AS told FROM x),
  z AS (SELECT key, 'start' AS "row", "at", started, 'active' AS status, '{AUTOMATIC}' AS goal, NULL AS summary, 0 AS n_files, '' AS files, '' AS tags FROM y WHERE "row" = 'start'
    UNION ALL SELECT y.key, 'entry', "at", started, 'active', goal, n.text, n_files, array_to_string(files, ','), 'session-summary,session-checkpoint,' || y.key FROM y JOIN n ON n.key = y.key AND n.o = y.o WHERE "row" = 'checkpoint'
    UNION ALL SELECT key, 'end', "at", started, 'completed', goal, told, n_files, array_to_string(files, ','), '' FROM y WHERE "row" = 'end'
    UNION ALL SELECT key, 'entry', "at", started, 'completed', goal, told, n_files, array_to_string(files, ','), 'session-summary,session-end,' || key FROM y WHERE "row" = 'end')
  SELECT key, "row", epoch_us("at") AS "at", epoch_us(started) AS started, status, goal, summary, n_files, files, tags FROM z""")
def session_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that the sessions of all users make: starts, checkpoints, ends by their users and by idleness."""
    made = session_rows(derived(spark, sf_dir, ACTIVITY, "events"), NOW * 1_000_000)
    return made.select(
        "key", "row", F.unix_micros("at").alias("at"), F.unix_micros("started_at").alias("started"), "status", "goal", "summary", "n_files",
        F.array_join("files", ",").alias("files"), F.array_join("tags", ",").alias("tags"),
    )

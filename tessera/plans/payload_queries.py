"""Insights out of tool payloads that are planted in the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import payloads as P
from tessera.sources.shared import written

from .registry import query
from .tables import table

#: a payload for each event, of every tool and rule, among them broken ones and fields of other types; chr(92) is a backslash
PAYLOAD = """CASE event_id % 21
  WHEN 0 THEN concat('{"tool_name":"Edit","session_id":"s', u, '","tool_input":{"file_path":"conf/d', e, '/app.toml","old_string":"pool = ', v, '","new_string":"pool = ', v, '0"}}')
  WHEN 1 THEN concat('{"tool_name":"Edit","session_id":"s', u, '","tool_input":{"file_path":"src/cfg.rs","old_string":"let port = 3000;","new_string":"// ', repeat('long line ', 30), chr(92), 'n  let port = std::env::var(', chr(92), '"PORT_', e, chr(92), '").unwrap();"}}')
  WHEN 2 THEN concat('{"tool_name":"MultiEdit","session_id":"s', u, '","tool_input":{"file_path":"web/vite.config.ts","old_string":"', repeat('x', 250), '","new_string":"process.env.KEY', e, '"}}')
  WHEN 3 THEN concat('{"tool_name":"Write","session_id":"s', u, '","tool_input":{"file_path":"svc', v, '/Dockerfile.dev"}}')
  WHEN 4 THEN concat('{"tool_name":"Create","session_id":"s', u, '","tool_input":{"file_path":".github/workflows/ci', v, '.yml"}}')
  WHEN 5 THEN concat('{"tool_name":"Write","session_id":"s', u, '","tool_input":{"file_path":"db/Migrations/', e, '_add.sql"}}')
  WHEN 6 THEN concat('{"tool_name":"Write","session_id":"s', u, '","tool_input":{"file_path":"deploy/values', v, '.yaml"}}')
  WHEN 7 THEN concat('{"tool_name":"Write","session_id":"s', u, '","tool_input":{"file_path":"pnpm-lock.yaml"}}')
  WHEN 8 THEN concat('{"tool_name":"Bash","session_id":"s', u, '","tool_input":{"command":"cargo test --all ', repeat('a', 120), '"},"tool_response":{"exitCode":101,"stdout":"x","stderr":"test a::ok ... ok', chr(92), 'ntest b::t', v, ' ... FAILED', chr(92), 'n  end"}}')
  WHEN 9 THEN concat('{"tool_name":"Bash","session_id":"s', u, '","tool_input":{"command":"NPX JEST"},"tool_response":{"exitCode":1,"stdout":"FAIL src/a', v, '.test.ts","stderr":""}}')
  WHEN 10 THEN concat('{"tool_name":"Bash","session_id":"s', u, '","tool_input":{"command":"pytest -q"},"tool_response":{"exitCode":1,"stdout":"no mark ', e, '"}}')
  WHEN 11 THEN concat('{"tool_name":"Bash","session_id":"s', u, '","tool_input":{"command":"make all"},"tool_response":{"exitCode":2,"stderr":"', repeat('e', 600), v, '"}}')
  WHEN 12 THEN concat('{"tool_name":"Bash","session_id":"s', u, '","tool_input":{"command":"ruff check src/', e, '"},"tool_response":{"exitCode":1,"stdout":"E501"}}')
  WHEN 13 THEN concat('{"tool_name":"Bash","session_id":"s', u, '","tool_input":{"command":"cargo build"},"tool_response":{"exitCode":0,"stderr":"fine"}}')
  WHEN 14 THEN concat('{"tool_name":"Bash","session_id":"s', u, '","tool_input":{"command":"make all"},"tool_response":{"exitCode":"2","stderr":"exit code is text"}}')
  WHEN 15 THEN concat('{"tool_name":"Read","session_id":"s', u, '","tool_input":{"file_path":"a.toml"}}')
  WHEN 16 THEN concat('{"tool_name":"mcp__store__save","tool_input":{"file_path":"a.toml"}}')
  WHEN 17 THEN concat('{"tool_name":"Edit","tool_input":{"file_path":', e, ',"old_string":"a","new_string":"process.env.X"}}')
  WHEN 18 THEN concat('{"tool_name":', e, ',"tool_input":{}}')
  WHEN 19 THEN concat('{"tool_name":"Write","session_id":', e, ',"tool_input":{"file_path":"Dockerfile"}}')
  ELSE CASE event_id % 3 WHEN 0 THEN concat('{"tool_name":"Edit"', e) WHEN 1 THEN '["Edit"]' ELSE NULL END END"""
_PARTS = "CAST(event_id AS STRING) AS e, CAST(event_id % 5 AS STRING) AS v, CAST(user_id AS STRING) AS u"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", *_PARTS.split(", "))
    return written(named.select("event_id", "ts", F.expr(PAYLOAD).alias("payload")))  # a table of its own, as a store would hand it over


_PLANTED = f"p AS (SELECT event_id, ts, {PAYLOAD} AS payload FROM (SELECT event_id, user_id, ts, {_PARTS} FROM events))"


def _contains(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _field(path: str) -> str:
    return f"CASE WHEN json_type(payload, '{path}') = 'VARCHAR' THEN json_extract_string(payload, '{path}') ELSE '' END"


_CONFIG = "(NOT contains(name, 'lock') AND (ends_with(name, '.toml') OR ends_with(name, '.yaml') OR ends_with(name, '.yml') OR contains(name, '.config.') OR name IN ({})))".format(", ".join(f"'{n}'" for n in P.CONFIG_NAMES))
_SHORT = lambda c, n: f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"
_FENCE = lambda c: f"'```' || chr(10) || {c} || chr(10) || '```'"
_GAP = "chr(10) || chr(10)"
_RULES = f"""{_PLANTED},
good AS (SELECT event_id, ts, payload, json_extract_string(payload, '$.tool_name') AS tool, json_extract_string(payload, '$.session_id') AS session FROM p
  WHERE json_valid(payload) AND json_type(payload, '$.tool_name') = 'VARCHAR' AND coalesce(json_type(payload, '$.session_id'), 'NULL') IN ('VARCHAR', 'NULL')),
f AS (SELECT event_id, ts, tool, session, {_field('$.tool_input.file_path')} AS path, {_field('$.tool_input.old_string')} AS old, {_field('$.tool_input.new_string')} AS new, {_field('$.tool_input.command')} AS command,
  CASE WHEN json_type(payload, '$.tool_response.exitCode') IN ('BIGINT', 'UBIGINT') THEN json_extract_string(payload, '$.tool_response.exitCode')::BIGINT ELSE 0 END AS code,
  CASE WHEN {_field('$.tool_response.stderr')} <> '' THEN {_field('$.tool_response.stderr')} ELSE {_field('$.tool_response.stdout')} END AS output FROM good),
g AS (SELECT *, lower(path) AS low, lower(regexp_extract(path, '[^/]*$')) AS name, regexp_extract(path, '[^/]*$') AS file, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem,
  coalesce(nullif(regexp_extract(new, 'env::var\\(["'']([A-Za-z0-9_]+)', 1), ''), nullif(regexp_extract(new, 'process\\.env\\.([A-Za-z0-9_]+)', 1), ''), 'unknown') AS var,
  coalesce(list_extract(list_filter(list_transform(string_split(output, chr(10)), lambda s: CASE WHEN ends_with(trim(s), 'FAILED') AND starts_with(trim(s), 'test ') THEN replace(substr(trim(s), 6), ' ... FAILED', '') WHEN starts_with(trim(s), 'FAIL ') THEN substr(trim(s), 6) END), lambda x: x IS NOT NULL), -1), 'unknown') AS test,
  substr(md5(output), 1, 6) AS h, lower(command) AS c FROM f),
e AS (SELECT * FROM g WHERE tool IN ('Edit', 'MultiEdit') AND path <> '' AND old <> '' AND new <> ''),
w AS (SELECT *, CASE WHEN starts_with(name, 'dockerfile') OR name = 'containerfile' THEN 'Dockerfile created' WHEN contains(low, '.github/workflows/') OR name IN ('.gitlab-ci.yml', '.gitlab-ci.yaml') THEN 'CI configuration created'
  WHEN (contains(low, 'migration') OR contains(low, 'migrate')) AND regexp_matches(low, '\\.(sql|rs|py)$') THEN 'Database migration created' WHEN {_CONFIG} THEN 'config' END AS label FROM g WHERE tool IN ('Write', 'Create') AND path <> ''),
b AS (SELECT *, CASE WHEN {_contains('c', P.TEST_COMMANDS)} THEN 't' WHEN {_contains('c', P.BUILD_COMMANDS)} THEN 'b' WHEN {_contains('c', P.LINT_COMMANDS)} THEN 'l' END AS kind FROM g WHERE tool = 'Bash' AND code <> 0 AND command <> ''),
x AS (
  SELECT event_id, ts, session, 'config change' AS rule, 'Config change: ' || stem AS title, 'Configuration updated in `' || path || '`.' || {_GAP} || '**Changed:**' || chr(10) || {_FENCE(_SHORT('old', 200))} || chr(10) || '→' || chr(10) || {_FENCE(_SHORT('new', 200))} AS content, 'decision' AS type, ['auto-extract', 'config', path] AS tags, 'config:' || stem AS topic_key, 0.7::DOUBLE AS confidence FROM e WHERE {_CONFIG}
  UNION ALL SELECT event_id, ts, session, 'env var', 'New env var: ' || var || ' in ' || stem, 'Environment variable `' || var || '` is read in `' || path || '`.' || {_GAP} || {_FENCE(_SHORT("trim(list_extract(list_filter(string_split(new, chr(10)), lambda s: contains(s, var)), 1))", 200))}, 'decision', ['auto-extract', 'env-var', path], 'env:' || var, 0.7 FROM e WHERE NOT {_contains('old', P.ENVIRONMENT)} AND {_contains('new', P.ENVIRONMENT)}
  UNION ALL SELECT event_id, ts, session, 'new file', label || ': ' || path, label || ' at `' || path || '`.', 'architecture', ['auto-extract', 'architecture', path], 'newfile:' || path, CASE substr(label, 1, 2) WHEN 'Do' THEN 0.9 WHEN 'CI' THEN 0.85 ELSE 0.8 END FROM w WHERE label <> 'config'
  UNION ALL SELECT event_id, ts, session, 'new config', 'New config: ' || file, 'Configuration file created at `' || path || '`.', 'decision', ['auto-extract', 'config', path], 'newfile:' || path, 0.7 FROM w WHERE label = 'config'
  UNION ALL SELECT event_id, ts, session, 'test failure', 'Test failure: ' || {_SHORT('test', 60)}, 'Test command failed: `' || {_SHORT('command', 100)} || '`' || {_GAP} || '**Failing test:** ' || test || {_GAP} || '**Output (truncated):**' || chr(10) || {_FENCE(_SHORT('output', 500))}, 'bug', ['auto-extract', 'test-failure'], 'testfail:' || h, 0.75 FROM b WHERE kind = 't'
  UNION ALL SELECT event_id, ts, session, 'build error', 'Build error: ' || {_SHORT('command', 60)}, 'Build failed: `' || {_SHORT('command', 100)} || '`' || {_GAP} || '**Error (truncated):**' || chr(10) || {_FENCE(_SHORT('output', 500))}, 'auto-change', ['auto-extract', 'build-error'], 'builderr:' || h, 0.7 FROM b WHERE kind = 'b'
  UNION ALL SELECT event_id, ts, session, 'lint', 'Lint violations: ' || {_SHORT('command', 60)}, 'Linter found issues: `' || {_SHORT('command', 100)} || '`' || {_GAP} || '**Output (truncated):**' || chr(10) || {_FENCE(_SHORT('output', 500))}, 'tech-debt', ['auto-extract', 'lint'], 'lint:' || h, 0.7 FROM b WHERE kind = 'l'
)"""


@query(f"WITH {_RULES} SELECT event_id, rule, title, content, type, array_to_string(tags, '|') AS tags, topic_key, confidence FROM x WHERE confidence >= 0.7")
def payload_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over every payload; calls of own tools, reads and successful commands say nothing."""
    found = P.insights(payloads(spark, sf_dir))
    return found.select("event_id", "rule", "title", "content", "type", F.array_join("tags", "|").alias("tags"), "topic_key", "confidence")


@query(f"""WITH {_PLANTED} SELECT event_id, CASE WHEN payload IS NULL OR NOT json_valid(payload) OR json_type(payload) <> 'OBJECT' THEN 'no object' WHEN coalesce(json_type(payload, '$.tool_name'), '') <> 'VARCHAR' THEN 'no tool name'
  WHEN json_type(payload, '$.session_id') NOT IN ('VARCHAR', 'NULL') THEN 'session is no text' END AS fault FROM p WHERE fault IS NOT NULL""")
def rejected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rejected(payloads(spark, sf_dir)).select("event_id", "fault")


@query(f"WITH {_RULES} SELECT type, rule, count(*) AS insights, count(DISTINCT topic_key) AS topics, count(DISTINCT session) AS sessions FROM x GROUP BY type, rule")
def insight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.insights(payloads(spark, sf_dir))
    return found.groupBy("type", "rule").agg(F.count("*").alias("insights"), F.countDistinct("topic_key").alias("topics"), F.countDistinct("session").alias("sessions"))


@query()
def saved_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each session saves under its limits; held against a plain loop in the tests."""
    found = P.saved_insights(P.insights(payloads(spark, sf_dir)), "ts", "event_id")
    return found.select("event_id", "session", "rule", "topic_key")

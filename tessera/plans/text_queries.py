"""Text functions, filters and redaction over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import redact as D
from tessera.functions import text as T

from .registry import query
from .tables import table


@query("""SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS short, ceil(length(text) / 4.0)::BIGINT AS tokens,
  CASE WHEN length(text) > 500 THEN substr(text, 1, greatest(500 - length(m), 0)::BIGINT) || m ELSE text END AS bounded
  FROM (SELECT *, chr(10) || chr(10) || '… [truncated ' || (length(text) - 500) || ' chars]' AS m FROM documents)""")
def text_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.shortened(t, 60).alias("short"), T.token_estimate(t).alias("tokens"), T.bounded(t, 500).alias("bounded"))


@query("""SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-', ''), 1, 64), '-$', '') AS s FROM documents)""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, 'a [redacted] b ' || text || ' [redacted]' AS text FROM documents")
def private_blocks(spark, sf_dir):
    said = F.concat(F.lit("a <PRIVATE>"), "text", F.lit("</private> b "), "text", F.lit(" <private>"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.without_private(said).alias("text"))


ACKS = ", ".join(f"'{x}'" for x in T.ACKNOWLEDGEMENTS)


@query(f"SELECT conv_id, turn, coalesce(p = '' OR starts_with(p, '/') OR p IN ({ACKS}), true) AS trivial FROM (SELECT conv_id, turn, lower(trim(CASE WHEN turn % 4 = 3 THEN ' Dale ' WHEN turn % 4 = 2 THEN '/' || text ELSE text END)) AS p FROM conversations)")
def trivial_prompts(spark, sf_dir):
    said = F.when(F.col("turn") % 4 == 3, " Dale ").when(F.col("turn") % 4 == 2, F.concat(F.lit("/"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_trivial(said).alias("trivial"))


SAID = """SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN concat('<ide_selection> ', text) WHEN 2 THEN concat('You are a judge.', chr(10), '{"a": 1}', text)
  WHEN 3 THEN concat(repeat(concat('2024-01-01 10:00:00 INFO started', chr(10)), 400), text) WHEN 4 THEN concat('Your task is plain. ', text) ELSE text END AS said FROM {documents}"""
MARKS = " OR ".join(f"contains(low, '{m}')" for m in T.MACHINE_MARKS)
ORDERS = " OR ".join(f"contains(substr(low, 1, 80), '{m}')" for m in T.ORDERS)


@query(f"""SELECT doc_id, coalesce({MARKS} OR (len(lines) > 30 AND loggy * 100 > len(lines) * 80)
    OR (({ORDERS}) AND (blocks > 0 OR contains(said, '":') OR contains(said, ': {{') OR contains(said, ':{{'))), false) AS machine_made FROM (
  SELECT doc_id, said, lower(said) AS low, lines, len(list_filter(lines, lambda x: regexp_matches(trim(x), '^<[A-Za-z].*>$'))) AS blocks,
    len(list_filter(lines, lambda x: length(ltrim(x)) >= 10 AND (regexp_matches(ltrim(x), '^(at |\\[|.?(ERROR|WARN|INFO|DEBUG|TRACE))') OR length(regexp_replace(substr(ltrim(x), 1, 10), '[^0-9]', '', 'g')) >= 6))) AS loggy
  FROM (SELECT *, string_split(said, chr(10)) AS lines FROM ({SAID.replace("{documents}", "documents")})))""")
def machine_prompts(spark, sf_dir):
    """Plain texts, and texts behind each of the marks of prompts that machines wrote."""
    said = spark.sql(SAID.replace('{"a": 1}', '{{"a": 1}}'), documents=table(spark, sf_dir, "documents"))
    return said.select("doc_id", T.is_machine_made(F.col("said")).alias("machine_made"))


LINED = "SELECT doc_id, concat('// TODO: ', text, chr(10), 'let x = 1;', chr(10), '  # fixme later', chr(10), '-- NOTE this', chr(10), 'TODO bare') AS source FROM {documents}"


@query(f"""SELECT doc_id, k - 1 AS line, m AS marker FROM (SELECT doc_id, k, regexp_extract(upper(s), '^\\s*(//+|#+|--|\\*|/\\*)\\s*(TODO|FIXME|HACK|XXX|OPTIMIZE|BUG|NOTE)', 2) AS m FROM (
  SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(source, chr(10)) AS l FROM ({LINED.format(documents="documents")})))) WHERE m <> ''""")
def debt_markers(spark, sf_dir):
    lines = spark.sql(LINED, documents=table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("source", "\n")).alias("line", "s"))
    return lines.select("doc_id", "line", T.marker_of(F.col("s")).alias("marker")).where("marker is not null")


@query()
def debt_in_files(spark, sf_dir):
    """Markers in comments of whole texts taken as files; held against a plain loop in the tests."""
    files = spark.sql(LINED, documents=table(spark, sf_dir, "documents")).select("doc_id", "source")
    found = files.select("doc_id", F.explode(T.debt_of(F.col("source"), F.lit("a.rs"))).alias("x"))
    return found.select("doc_id", "x.line", "x.marker")


def _formats(text: str) -> str:
    for kind, pattern in D.WHOLE:
        text = f"regexp_replace({text}, '{pattern}', '[REDACTED:{kind}]', 'g')"
    text = f"regexp_replace({text}, '://([^/\\s:@]{{1,64}}):([^@/\\s]{{1,256}})@', '://\\1:[REDACTED:url-credentials]@', 'g')"
    return f"regexp_replace({text}, '{D.BEARER}', '\\1[REDACTED:bearer-header]', 'g')"


#: planted with one credential for each of a few formats, put together so that no literal one stands here
PLANTED = "SELECT doc_id, concat(text, ' ://u:p', 'w1@h ', CASE doc_id % 4 WHEN 0 THEN concat('gh', 'p_', repeat('a1', 18)) WHEN 1 THEN concat('AK', 'IA', repeat('Q', 16)) WHEN 2 THEN concat('Bea', 'rer ', repeat('abcd', 5)) ELSE concat('np', 'm_', repeat('b2', 18)) END, ' end') AS text FROM {documents}"


@query(f"SELECT doc_id, {_formats('text')} AS clean FROM ({PLANTED.format(documents='documents')})")
def secret_formats(spark, sf_dir):
    return spark.sql(PLANTED, documents=table(spark, sf_dir, "documents")).select("doc_id", D.without_formats(F.col("text")).alias("clean"))


#: values of key-like names, of every kind that the decision tells apart; repeated and joined here, so that no literal credential stands in the code
KEYED = """CASE doc_id % 16 WHEN 0 THEN concat('hunter', CAST(doc_id AS STRING), 'xyz') WHEN 1 THEN concat('q9X2vLp8', 'Rj4tYw7ZnB3mK6dF1sG5hA0c', CAST(doc_id AS STRING)) WHEN 2 THEN repeat('ab', 15) WHEN 3 THEN concat('path/to/keys/deploy/', CAST(doc_id AS STRING), '/id')
  WHEN 4 THEN concat('get_token', CAST(doc_id AS STRING), '()') WHEN 5 THEN '<your-api-key>' WHEN 6 THEN '$DB_PASSWORD' WHEN 7 THEN repeat('3f5a2b8c', 5) WHEN 8 THEN '550e8400-e29b-41d4-a716-446655440000' WHEN 9 THEN concat('9f86d081884c7d65', '9a2feaa0c55ad015')
  WHEN 10 THEN concat('wJalrXUtnFEMI/K7MDENG/', 'bPxRfiCyEXAMPLE', CAST(doc_id AS STRING)) WHEN 11 THEN 'a1b2c3d4e5' WHEN 12 THEN 'short' WHEN 13 THEN repeat('0123456789abcdef', 2) WHEN 14 THEN concat('Zx9', repeat('k', 15)) ELSE concat('Zx9', repeat('k', 20)) END"""
KEYS = "CASE doc_id % 7 WHEN 0 THEN 'password=' WHEN 1 THEN 'DB_PASSWORD = ' WHEN 2 THEN '\"api_key\": \"' WHEN 3 THEN 'api-key:' WHEN 4 THEN 'x_secret=' WHEN 5 THEN 'Session_Token = ' ELSE 'ssh_key=' END"
_CHARS = "string_split(v, '')"
_BITS = f"-list_sum(list_transform(list_distinct({_CHARS}), lambda x: len(list_filter({_CHARS}, lambda y: y = x)) / length(v)::DOUBLE * log2(len(list_filter({_CHARS}, lambda y: y = x)) / length(v)::DOUBLE)))"
#: the decision in SQL: too short to count, a version, a stand-in, a path, long but plain
_STAYS = f"""(length(v) < 8 OR regexp_matches(v, '{D.COMMIT}') OR regexp_matches(v, '{D.UUID}') OR starts_with(v, '$') OR contains(v, '(') OR (starts_with(v, '<') AND ends_with(v, '>'))
  OR (length(v) - length(replace(v, '/', '')) >= 2 AND regexp_matches(v, '{D.PATH}')) OR (length(v) >= {D.LONG} AND {_BITS} <= {D.LEAST_ENTROPY}))"""


@query(f"""SELECT doc_id, clean, len(regexp_extract_all(clean, '\\[REDACTED:')) AS hits FROM (SELECT doc_id, {_formats('text')} || ' ' || k || CASE WHEN {_STAYS} THEN v ELSE '[REDACTED:keyed-secret]' END || ' token=$VAR' AS clean
  FROM (SELECT doc_id, text, {KEYS} AS k, {KEYED} AS v FROM ({PLANTED.format(documents='documents')})))""")
def redaction(spark, sf_dir):
    """Whole texts with planted credentials and keyed values of every kind, without their secrets, and how many marks stand in them."""
    planted = spark.sql(PLANTED, documents=table(spark, sf_dir, "documents"))
    leaking = planted.select("doc_id", F.concat("text", F.lit(" "), F.expr(KEYS), F.expr(KEYED), F.lit(" token=$VAR")).alias("text"))
    clean = D.redacted_rows(leaking, ["text"])
    return clean.select("doc_id", F.col("text").alias("clean"), F.size(D.hits(F.col("text"))).alias("hits"))


@query("""SELECT conv_id, turn, round(-list_sum(list_transform(list_distinct(c), lambda x: len(list_filter(c, lambda y: y = x)) / len(c)::DOUBLE * log2(len(list_filter(c, lambda y: y = x)) / len(c)::DOUBLE))), 5) AS bits
  FROM (SELECT conv_id, turn, string_split(text, '') AS c FROM conversations WHERE length(text) > 0)""")
def entropy(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.length("text") > 0)
    return rows.select("conv_id", "turn", F.round(D.entropy(F.col("text")), 5).alias("bits"))


#: names in several styles for each part, with the words that they are made of
NAMES = """CASE p_partkey % 5 WHEN 0 THEN concat('parse', upper(substr(w, 1, 1)), substr(w, 2), 'Cache') WHEN 1 THEN concat(w, '_state_', CAST(p_size AS STRING)) WHEN 2 THEN concat('HTTP', upper(substr(w, 1, 1)), substr(w, 2)) WHEN 3 THEN concat('a', upper(substr(w, 1, 1)), substr(w, 2)) ELSE concat(w, '.x::', w) END"""


@query(f"""SELECT p_partkey, item, CASE p_partkey % 5 WHEN 0 THEN 'parse ' || w || ' cache ' || lower(item) WHEN 1 THEN w || ' state ' || CASE WHEN p_size > 9 THEN p_size || ' ' ELSE '' END || lower(item) WHEN 2 THEN 'http ' || w || ' ' || lower(item) WHEN 3 THEN w || ' ' || lower(item) ELSE w || ' ' || w || ' ' || lower(item) END AS tokens
  FROM (SELECT *, {NAMES} AS item FROM (SELECT p_partkey, p_size, regexp_extract(lower(p_name), '[a-z][a-z]+') AS w FROM part))""")
def name_tokens(spark, sf_dir):
    """Words of names in camel, snake and dotted style, made of the parts' own names."""
    words = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.regexp_extract(F.lower("p_name"), "[a-z][a-z]+", 0).alias("w"))
    return words.select("p_partkey", F.expr(NAMES).alias("item")).select("p_partkey", "item", T.name_tokens(F.col("item")).alias("tokens"))

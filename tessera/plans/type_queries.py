"""Closures of type relations, and calls through fields and traits, over graphs made of parts, suppliers and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import types as Y

from .registry import query
from .tables import derived

#: cycles of seven types, some of which lead on to the next one
LINKS = """SELECT p_partkey AS source, CASE WHEN p_partkey % 7 = 6 THEN p_partkey - 6 ELSE p_partkey + 1 END AS target FROM {part}
  UNION ALL SELECT p_partkey, p_partkey + 7 FROM {part} WHERE p_partkey % 21 = 0 UNION ALL SELECT p_partkey, p_partkey FROM {part} WHERE p_partkey % 50 = 0"""
#: members of forty types, of which the first five are traits; each name is a member of all of them
MEMBERS = "SELECT p_partkey AS id, concat('m', CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING)) AS name, concat('T', CAST(p_partkey % 40 AS STRING)) AS container FROM {part}"
CALLED = """SELECT l_orderkey * 10 + l_linenumber AS call_id, concat('f', CAST(l_suppkey % 53 AS STRING)) AS file_path, concat('T', CAST(l_suppkey % 40 AS STRING)) AS container,
  CASE l_linenumber % 3 WHEN 0 THEN concat('self.x', CAST(l_partkey % 9 AS STRING)) WHEN 1 THEN concat('this.x', CAST(l_partkey % 9 AS STRING)) ELSE concat('self.x', CAST(l_partkey % 9 AS STRING), '.y') END AS qualifier,
  concat('m', CAST(CAST(floor(l_partkey / 40) AS BIGINT) AS STRING)) AS callee FROM {lineitem}"""
VISIBLE = "SELECT DISTINCT concat('f', CAST(s_suppkey % 53 AS STRING)) AS file_path, concat('T', CAST(s_suppkey * 7 % 40 AS STRING)) AS owner FROM {supplier}"
FIELDS = """SELECT concat('T', CAST(s_suppkey % 40 AS STRING)) AS container, concat('x', CAST(CAST(floor(s_suppkey / 40) AS BIGINT) % 9 AS STRING)) AS name,
  CASE s_suppkey % 4 WHEN 0 THEN concat('pub x: Arc<dyn T', CAST(s_suppkey * 3 % 40 AS STRING), '>') WHEN 1 THEN concat('x: Map<T', CAST(s_suppkey % 40 AS STRING), ', T1>') WHEN 2 THEN 'x: usize'
    ELSE concat('private readonly x: T', CAST(s_suppkey * 3 % 40 AS STRING), ' | T', CAST(s_suppkey * 3 % 40 AS STRING)) END AS signature FROM {supplier}"""
#: types implement the trait of their remainder by five, some by way of another type
IMPLEMENTS = """SELECT DISTINCT concat('T', CAST(p_partkey % 40 AS STRING)) AS source, concat('T', CAST(CASE WHEN p_partkey % 40 >= 20 THEN p_partkey % 40 - 15 ELSE p_partkey % 5 END AS STRING)) AS target
  FROM {part} WHERE p_partkey % 40 >= 5 AND p_partkey % 4 < 3"""
_NAMES = {"part": "part", "lineitem": "lineitem", "supplier": "supplier"}


def _sql(text: str) -> str:
    return text.format(**_NAMES)


@query(f"WITH RECURSIVE l AS ({_sql(LINKS)}), c AS (SELECT source, target FROM l UNION SELECT c.source, l.target FROM c JOIN l ON l.source = c.target) SELECT source, target FROM c")
def type_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs over cycles of seven types."""
    return Y.closure(derived(spark, sf_dir, LINKS, "part"))


@query(f"""WITH f AS ({_sql(FIELDS)}), m AS ({_sql(MEMBERS)}), k AS (SELECT DISTINCT container AS name FROM m),
  o AS (SELECT container, name, min(signature) AS s FROM f GROUP BY 1, 2 HAVING count(*) = 1),
  w AS (SELECT DISTINCT container, name, unnest(string_split_regex(substr(s, strpos(s, ':') + 1), '[^A-Za-z0-9_]+')) AS type FROM o),
  t AS (SELECT container, name, min(type) AS type FROM w WHERE type IN (SELECT name FROM k) GROUP BY 1, 2 HAVING count(*) = 1),
  c AS (SELECT *, regexp_extract(qualifier, '^(self|this)\\.([^.]+)$', 2) AS field FROM ({_sql(CALLED)})),
  u AS (SELECT container, name, min(id) AS id FROM m GROUP BY 1, 2 HAVING count(*) = 1)
  SELECT call_id, u.id AS target, 'field_type' AS resolution, 0.85::DOUBLE AS confidence FROM c JOIN t ON t.container = c.container AND t.name = c.field JOIN u ON u.container = t.type AND u.name = c.callee""")
def field_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = derived(spark, sf_dir, MEMBERS, "part")
    containers = members.select(F.col("container").alias("name"))
    return Y.field_calls(derived(spark, sf_dir, CALLED, "lineitem"), derived(spark, sf_dir, FIELDS, "supplier"), members, containers)


@query(f"""WITH RECURSIVE i AS ({_sql(IMPLEMENTS)}), r AS (SELECT source, target FROM i UNION SELECT r.source, i.target FROM r JOIN i ON i.source = r.target),
  c AS ({_sql(CALLED)}), m AS ({_sql(MEMBERS)}), v AS ({_sql(VISIBLE)}),
  a AS (SELECT DISTINCT file_path, callee FROM c WHERE callee <> 'm7'), k AS (SELECT a.file_path, a.callee, m.id, m.container AS owner, m.container IN ('T0', 'T1', 'T2', 'T3', 'T4') AS declares FROM a JOIN v USING (file_path) JOIN m ON m.container = v.owner AND m.name = a.callee),
  g AS (SELECT file_path, callee, count(*) AS n, count(*) FILTER (declares) AS d, min(id) AS one, min(id) FILTER (declares) AS method, min(owner) FILTER (declares) AS trait FROM k GROUP BY 1, 2),
  x AS (SELECT file_path, callee, one AS target, 'suffix' AS resolution, 0.55 AS confidence FROM g WHERE n = 1
    UNION ALL SELECT file_path, callee, method, 'trait_method', 0.70 FROM g WHERE n > 1 AND d = 1
      AND NOT EXISTS (SELECT 1 FROM k WHERE k.file_path = g.file_path AND k.callee = g.callee AND k.owner <> g.trait AND NOT EXISTS (SELECT 1 FROM r WHERE r.source = k.owner AND r.target = g.trait)))
  SELECT call_id, target, resolution, confidence::DOUBLE AS confidence FROM c JOIN x USING (file_path, callee)""")
def trait_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on receivers of unknown type, by the closure of what implements what."""
    traits = spark.range(5).select(F.concat(F.lit("T"), "id").alias("name"))
    reach = Y.closure(derived(spark, sf_dir, IMPLEMENTS, "part"))
    return Y.trait_calls(derived(spark, sf_dir, CALLED, "lineitem"), derived(spark, sf_dir, MEMBERS, "part"), derived(spark, sf_dir, VISIBLE, "supplier"), traits, reach, common=("m7",))

"""Walks, fan counts, importance and call resolution over graphs made of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as G

from .registry import query
from .tables import CALLS, CHAIN, NODES, NOW, derived, now, table, with_tables


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CALLS, "lineitem")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CHAIN, "lineitem")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, NODES, "orders", "part", "supplier")


@query(with_tables("""SELECT n.id, coalesce(i.s, 0) AS sites_in, coalesce(i.c, 0) AS callers, coalesce(o.s, 0) AS sites_out, coalesce(o.c, 0) AS callees FROM (SELECT id FROM nodes WHERE id % 3 > 0) n
  LEFT JOIN (SELECT target AS id, count(*) s, count(DISTINCT source) c FROM calls GROUP BY 1) i USING (id) LEFT JOIN (SELECT source AS id, count(*) s, count(DISTINCT target) c FROM calls GROUP BY 1) o USING (id)"""))
def fan_counts(spark, sf_dir):
    return G.fan_counts(nodes(spark, sf_dir).where("id % 3 > 0"), calls(spark, sf_dir))


@query(with_tables("SELECT target AS id, count(*) AS sites FROM calls GROUP BY 1 ORDER BY sites DESC, id LIMIT 15"))
def hubs(spark, sf_dir):
    return G.hubs(calls(spark, sf_dir), 15)


WALK = """WITH RECURSIVE w AS (SELECT s AS id, 0 AS depth FROM (VALUES (3), (6)) v(s) UNION SELECT c.target, w.depth + 1 FROM w JOIN chain c ON c.source = w.id WHERE w.depth < 3)
  SELECT id::BIGINT AS id, min(depth) AS depth FROM w GROUP BY 1"""


def _walk(spark, sf_dir):
    return G.walk(chain(spark, sf_dir), spark.range(3, 7, 3), 3)


@query(with_tables(WALK))
def bounded_walk(spark, sf_dir):
    return _walk(spark, sf_dir)


@query(with_tables(f"SELECT count(*) > 0 AS truncated FROM chain c JOIN ({WALK}) w ON c.source = w.id AND w.depth = 3 WHERE c.target NOT IN (SELECT id FROM ({WALK}))"))
def walk_truncated(spark, sf_dir):
    return G.truncated(chain(spark, sf_dir), _walk(spark, sf_dir), 3)


def _symbols(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("fn"), F.col("p_partkey") % 400).alias("name"),
        F.concat(F.lit("f"), F.col("p_partkey") % 53).alias("file_path"),
        F.concat(F.lit("f"), F.col("p_partkey") % 53, F.lit(":T"), F.col("p_partkey") % 9, F.lit(".fn"), F.col("p_partkey") % 400).alias("qualified_name"),
    )


SYMBOLS = "SELECT p_partkey AS id, 'fn' || (p_partkey % 400) AS name, 'f' || (p_partkey % 53) AS file_path, 'f' || (p_partkey % 53) || ':T' || (p_partkey % 9) || '.fn' || (p_partkey % 400) AS qualified_name FROM part"


@query(f"""SELECT asked, id, tier, count(*) OVER (PARTITION BY asked) AS total FROM (SELECT asked, id, tier, min(tier) OVER (PARTITION BY asked) AS best FROM (
  SELECT asked, id, CASE WHEN qualified_name = asked THEN 1 WHEN name = asked THEN 2 ELSE 3 END AS tier FROM ({SYMBOLS}) s, (VALUES ('fn7'), ('T3.fn12'), ('f1:T1.fn1'), ('none')) v(asked)
  WHERE qualified_name = asked OR name = asked OR ends_with(qualified_name, ':' || asked) OR ends_with(qualified_name, '.' || asked))) WHERE tier = best""")
def symbol_lookup(spark, sf_dir):
    names = spark.createDataFrame([("fn7",), ("T3.fn12",), ("f1:T1.fn1",), ("none",)], "asked string")
    return G.symbol_lookup(_symbols(spark, sf_dir), names)


CALL = "SELECT l_orderkey * 10 + l_linenumber AS call_id, 'f' || (l_suppkey % 53) AS file_path, 'fn' || (l_partkey % 450) AS callee FROM lineitem"
IMPORT = "SELECT DISTINCT 'f' || (s_suppkey % 53) AS file_path, 'fn' || (s_suppkey * 3 % 450) AS callee, 'f' || (s_suppkey * 3 % 53) AS source FROM supplier"


@query(f"""WITH s AS ({SYMBOLS}), c AS ({CALL}), i AS ({IMPORT}),
  f AS (SELECT call_id, s.id, 1 AS tier FROM c JOIN i USING (file_path, callee) JOIN s ON s.name = c.callee AND s.file_path = i.source
        UNION ALL SELECT call_id, s.id, 2 FROM c JOIN s ON s.name = c.callee AND s.file_path = c.file_path UNION ALL SELECT call_id, s.id, 3 FROM c JOIN s ON s.name = c.callee),
  o AS (SELECT call_id, tier, min(id) AS target FROM f GROUP BY 1, 2 HAVING min(id) = max(id))
  SELECT call_id, target, CASE tier WHEN 1 THEN 'import_map' WHEN 2 THEN 'same_module' ELSE 'unique_name' END AS resolution, CASE tier WHEN 1 THEN 0.95 WHEN 2 THEN 0.90 ELSE 0.75 END::DOUBLE AS confidence
  FROM o QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY tier) = 1""")
def resolved_calls(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 53).alias("file_path"), F.concat(F.lit("fn"), F.col("l_partkey") % 450).alias("callee"))
    k = F.col("s_suppkey")
    i = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), k % 53).alias("file_path"), F.concat(F.lit("fn"), k * 3 % 450).alias("local_name"), F.concat(F.lit("f"), k * 3 % 53).alias("source")).distinct()
    return G.resolved_calls(c, i, _symbols(spark, sf_dir))


#: a path for each node of the graph, of several kinds
PATH = """concat(CASE id % 6 WHEN 0 THEN 'src/main/f' WHEN 1 THEN 'db/migrations/m' WHEN 2 THEN 'docs/page' WHEN 3 THEN 'app/x/storage/f' WHEN 4 THEN 'lib/__tests__/t' ELSE 'core/handler' END,
  CAST(id AS STRING), CASE id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.sql' WHEN 2 THEN '.md' WHEN 5 THEN '.go' ELSE '.ts' END)"""


@query(with_tables("SELECT target AS asked, source AS id, 'n' || source AS qualified_name, line FROM calls WHERE target IN (SELECT DISTINCT target FROM calls WHERE target % 50 = 0)"))
def callers(spark, sf_dir):
    c = calls(spark, sf_dir)
    symbols = nodes(spark, sf_dir).select("id", F.concat(F.lit("n"), "id").alias("qualified_name"))
    return G.neighbours(c, symbols, c.where("target % 50 = 0").select(F.col("target").alias("id")), "callers")


@query(with_tables("SELECT source AS asked, target AS id, 'n' || target AS qualified_name, line FROM calls WHERE source % 50 = 0"))
def callees(spark, sf_dir):
    c = calls(spark, sf_dir)
    symbols = nodes(spark, sf_dir).select("id", F.concat(F.lit("n"), "id").alias("qualified_name"))
    return G.neighbours(c, symbols, c.where("source % 50 = 0").select(F.col("source").alias("id")))


@query(with_tables(f"SELECT id, depth, true AS truncated FROM ({WALK.replace('(VALUES (3), (6)) v(s)', '(VALUES (3)) v(s)')}) WHERE depth > 0 ORDER BY depth, id LIMIT 40"))
def trace(spark, sf_dir):
    return G.trace(chain(spark, sf_dir), spark.range(3, 4), 3, 40)


@query(with_tables("SELECT source, target, line, 'CALLS' AS type FROM calls UNION ALL SELECT source, target, 0, 'IMPLEMENTS' FROM chain WHERE source % 3 = 2"))
def all_edges(spark, sf_dir):
    made = chain(spark, sf_dir).where("source % 3 = 2").select("source", "target", F.lit(0).alias("line"), F.lit("IMPLEMENTS").alias("type"))
    return G.all_edges(calls(spark, sf_dir).withColumn("type", F.lit("CALLS")).union(made))


@query(f"""SELECT DISTINCT a.id AS source, b.id AS target, 'CALLS' AS type, l_linenumber AS line FROM lineitem JOIN ({SYMBOLS}) a ON a.qualified_name = 'f' || (l_partkey % 53) || ':T' || (l_partkey % 9) || '.fn' || (l_partkey % 400)
  JOIN ({SYMBOLS}) b ON b.qualified_name = 'f' || (l_suppkey % 53) || ':T' || (l_suppkey % 9) || '.fn' || (l_suppkey % 400)""")
def named_edges(spark, sf_dir):
    name = lambda k: F.concat(F.lit("f"), F.col(k) % 53, F.lit(":T"), F.col(k) % 9, F.lit(".fn"), F.col(k) % 400)
    c = table(spark, sf_dir, "lineitem").select(name("l_partkey").alias("source_name"), name("l_suppkey").alias("target_name"), F.lit("CALLS").alias("type"), F.col("l_linenumber").alias("line"))
    return G.edges_of(c, _symbols(spark, sf_dir))


LABELLED = """SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'build_' WHEN 2 THEN 'HTTP' ELSE 'load' END, CASE p_partkey % 5 WHEN 0 THEN 'Cache' WHEN 1 THEN 'State' WHEN 2 THEN 'Server' ELSE 'File' END, CAST(p_partkey % 7 AS STRING)) AS name,
  concat('f', CAST(p_partkey AS STRING)) AS qualified_name, CASE p_partkey % 3 WHEN 0 THEN 'Function' WHEN 1 THEN 'Struct' ELSE 'Const' END AS label FROM {part}"""


@query(f"""WITH s AS ({LABELLED.format(part='part')}), d AS (SELECT *, string_split(CASE id % 4 WHEN 0 THEN 'parse ' WHEN 1 THEN 'build ' WHEN 2 THEN 'http ' ELSE 'load ' END || CASE id % 5 WHEN 0 THEN 'cache' WHEN 1 THEN 'state' WHEN 2 THEN 'server' ELSE 'file' END || (id % 7) || ' ' || lower(name), ' ') AS w FROM s),
  q AS (SELECT * FROM (VALUES (1, 'parse'), (1, 'cache0'), (2, 'http'), (2, 'server3')) v(question, term)), t AS (SELECT id, label, qualified_name, len(w) AS size, unnest(w) AS term FROM d), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
  f AS (SELECT id, label, qualified_name, size, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), g AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM f)
  SELECT question, id, qualified_name, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) + CASE label WHEN 'Function' THEN 10 WHEN 'Struct' THEN 5 ELSE 0 END AS score
  FROM g JOIN q USING (term), n GROUP BY question, id, qualified_name, label QUALIFY row_number() OVER (PARTITION BY question ORDER BY round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) + CASE label WHEN 'Function' THEN 10 WHEN 'Struct' THEN 5 ELSE 0 END DESC, qualified_name, id) <= 12""")
def symbol_search(spark, sf_dir):
    asked = spark.createDataFrame([(1, "parse"), (1, "cache0"), (2, "http"), (2, "server3")], "question int, term string")
    return G.symbol_search(derived(spark, sf_dir, LABELLED, "part"), asked, 12)


@query("SELECT p_partkey AS id, p_size AS complexity FROM part WHERE p_size > 0 ORDER BY p_size DESC, 'fn' || (p_partkey % 400), p_partkey LIMIT 14")
def complexity_ranking(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("fn"), F.col("p_partkey") % 400).alias("name"), F.col("p_size").alias("complexity"))
    return G.ranked_symbols(rows, "complexity").select("id", "complexity")


RELATION = "SELECT l_orderkey * 10 + l_linenumber AS relation_id, concat('f', CAST(l_suppkey % 53 AS STRING)) AS file_path, concat('fn', CAST(l_partkey % 400 AS STRING)) AS subject, concat('fn', CAST(l_suppkey % 400 AS STRING)) AS object, 'INHERITS' AS kind FROM {lineitem}"


@query(f"""WITH s AS ({SYMBOLS}), r AS ({RELATION.format(lineitem='lineitem')}), e AS (SELECT relation_id, file_path, 0 AS side, subject AS name FROM r UNION ALL SELECT relation_id, file_path, 1, object FROM r),
  f AS (SELECT relation_id, side, 1 AS tier, s.id FROM e JOIN s USING (name, file_path) UNION ALL SELECT relation_id, side, 2, s.id FROM e JOIN s USING (name)),
  o AS (SELECT relation_id, side, tier, min(id) AS id FROM f GROUP BY 1, 2, 3 HAVING min(id) = max(id)), b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY relation_id, side ORDER BY tier) = 1)
  SELECT a.relation_id, a.id AS source, b.id AS target, 'INHERITS' AS kind FROM b a JOIN b USING (relation_id) WHERE a.side = 0 AND b.side = 1 AND a.id <> b.id""")
def related_types(spark, sf_dir):
    return G.related_types(derived(spark, sf_dir, RELATION, "lineitem"), _symbols(spark, sf_dir).withColumn("label", F.lit("Struct")))


MEMBERS = "SELECT p_partkey AS id, concat('fn', CAST(p_partkey % 400 AS STRING)) AS name, concat('f', CAST(p_partkey % 53 AS STRING)) AS file_path, CASE WHEN p_partkey % 3 > 0 THEN concat('T', CAST(p_partkey % 97 AS STRING)) END AS container FROM {part}"
QCALL = """SELECT l_orderkey * 10 + l_linenumber AS call_id, concat('f', CAST(l_suppkey % 53 AS STRING)) AS file_path, concat('T', CAST(l_suppkey % 97 AS STRING)) AS container,
  CASE l_linenumber % 4 WHEN 0 THEN 'self' WHEN 1 THEN concat('m', CAST(l_suppkey % 11 AS STRING)) WHEN 2 THEN concat('T', CAST(l_partkey % 97 AS STRING)) ELSE 'x' END AS qualifier, concat('fn', CAST(l_partkey % 400 AS STRING)) AS callee FROM {lineitem}"""
QIMPORT = "SELECT DISTINCT concat('f', CAST(s_suppkey % 53 AS STRING)) AS file_path, concat('m', CAST(s_suppkey % 11 AS STRING)) AS local_name, concat('f', CAST(s_suppkey * 3 % 53 AS STRING)) AS source FROM {supplier}"


@query(f"""WITH s AS ({MEMBERS.format(part='part')}), c AS ({QCALL.format(lineitem='lineitem')}), i AS ({QIMPORT.format(supplier='supplier')}),
  f AS (SELECT call_id, s.id, 1 AS tier FROM c JOIN s ON s.file_path = c.file_path AND s.container = c.container AND s.name = c.callee WHERE qualifier = 'self'
    UNION ALL SELECT call_id, s.id, 2 FROM c JOIN i ON i.file_path = c.file_path AND i.local_name = c.qualifier JOIN s ON s.file_path = i.source AND s.name = c.callee WHERE qualifier <> 'self'
    UNION ALL SELECT call_id, s.id, 3 FROM c JOIN s ON s.container = c.qualifier AND s.name = c.callee WHERE qualifier <> 'self'
    UNION ALL SELECT call_id, s.id, 4 FROM c JOIN s ON s.name = c.callee AND s.container IS NOT NULL WHERE qualifier <> 'self' AND callee NOT IN ('fn1', 'fn2')),
  o AS (SELECT call_id, tier, min(id) AS target FROM f GROUP BY 1, 2 HAVING min(id) = max(id))
  SELECT call_id, target, CASE tier WHEN 1 THEN 'same_module' WHEN 2 THEN 'import_map' WHEN 3 THEN 'unique_name' ELSE 'suffix' END AS resolution, CASE tier WHEN 1 THEN 0.90 WHEN 2 THEN 0.95 WHEN 3 THEN 0.75 ELSE 0.55 END::DOUBLE AS confidence
  FROM o QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY tier) = 1""")
def qualified_calls(spark, sf_dir):
    return G.qualified_calls(derived(spark, sf_dir, QCALL, "lineitem"), derived(spark, sf_dir, QIMPORT, "supplier"), derived(spark, sf_dir, MEMBERS, "part"), common=("fn1", "fn2"))


@query(f"""WITH c AS ({CALL}), r AS (SELECT call_id FROM c JOIN (SELECT name, file_path FROM ({SYMBOLS}) GROUP BY 1, 2 HAVING count(*) = 1) s ON s.name = c.callee AND s.file_path = c.file_path)
  SELECT file_path, count(*) AS unresolved FROM c WHERE call_id NOT IN (SELECT call_id FROM r) GROUP BY 1""")
def unresolved_calls(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 53).alias("file_path"), F.concat(F.lit("fn"), F.col("l_partkey") % 450).alias("callee"))
    one = _symbols(spark, sf_dir).groupBy(F.col("name").alias("callee"), "file_path").count().where("count = 1")
    return G.unresolved_by_file(c, c.join(one, ["callee", "file_path"]))


@query(with_tables("""WITH f AS (SELECT 'm' || (page_id % 40) AS module FROM pages), m AS (SELECT module, count(*) AS n FROM f GROUP BY 1), b AS (SELECT * FROM m ORDER BY n DESC, module LIMIT 22)
  SELECT 'total' AS part, 'nodes' AS key, (SELECT count(*) FROM part) AS n UNION ALL SELECT 'total', 'edges', (SELECT count(*) FROM calls) UNION ALL SELECT 'total', 'files', (SELECT count(*) FROM pages)
  UNION ALL SELECT 'module', module, n FROM b UNION ALL SELECT 'module', '(other)', sum(n)::BIGINT FROM m WHERE module NOT IN (SELECT module FROM b) HAVING sum(n) IS NOT NULL
  UNION ALL SELECT 'label', CASE p_partkey % 3 WHEN 0 THEN 'Function' WHEN 1 THEN 'Struct' ELSE 'Const' END, count(*) FROM part GROUP BY 2"""))
def view_payload(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("m"), F.col("page_id") % 40, F.lit("/f"), "page_id").alias("path"))
    return G.view_payload(derived(spark, sf_dir, LABELLED, "part"), calls(spark, sf_dir), files)


@query(with_tables(f"""SELECT {PATH} AS path, s AS score, CASE WHEN s >= 65 THEN 'deep' WHEN s >= 40 THEN 'medium' WHEN s >= 20 THEN 'light' ELSE 'skip' END AS band FROM (SELECT id, least(100, greatest(0,
    greatest(0, 30 - 5 * coalesce(depth, far)) + CASE WHEN n >= 10 THEN 25 WHEN n >= 5 THEN 20 WHEN n >= 3 THEN 15 WHEN n >= 1 THEN 10 ELSE 0 END
    + CASE id % 6 WHEN 0 THEN 5 WHEN 1 THEN 28 WHEN 2 THEN 15 WHEN 3 THEN 20 WHEN 4 THEN 3 ELSE 18 END
    + CASE WHEN lines > 500 THEN 10 WHEN lines > 200 THEN 7 WHEN lines > 50 THEN 4 WHEN lines < 20 THEN -5 ELSE 0 END
    + CASE WHEN age < 7 THEN 10 WHEN age < 30 THEN 7 WHEN age < 90 THEN 4 WHEN age < 180 THEN 2 ELSE 0 END))::INT AS s
  FROM (SELECT f.id, f.id * 7 % 700 AS lines, f.id % 200 AS age, w.depth, coalesce(i.n, 0) AS n, (SELECT max(depth) + 1 FROM ({WALK})) AS far FROM nodes f
    LEFT JOIN ({WALK}) w USING (id) LEFT JOIN (SELECT target AS id, count(DISTINCT source) AS n FROM chain GROUP BY 1) i USING (id)))"""))
def importance(spark, sf_dir):
    files = nodes(spark, sf_dir).select(F.expr(PATH).alias("path"), (F.col("id") * 7 % 700).alias("lines"), F.timestamp_seconds(F.lit(NOW) - (F.col("id") % 200) * 86400).alias("modified"))
    links = chain(spark, sf_dir).select(F.expr(PATH.replace("id", "target")).alias("target"), "source")
    return G.importance(files, links, _walk(spark, sf_dir).select(F.expr(PATH).alias("id"), "depth"), now())

"""Source files, change lists and plans: whole texts with planted lines, so that SQL can tell what must be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markdown as M
from tessera.operators import code
from tessera.sources import files as S

from .registry import query
from .tables import table


def _named(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _one_line() -> Column:
    return F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x09-\\x0D ]+", " "))


LINE = "trim(regexp_replace(coalesce(text, ''), '[\\x09-\\x0D ]+', ' ', 'g'))"


@query("""SELECT 'p' || page_id || CASE page_id % 4 WHEN 0 THEN '/pages/index.tsx' WHEN 1 THEN '/manage.py' ELSE '/src/main.rs' END AS path,
  CASE page_id % 4 WHEN 0 THEN 'nextjs' WHEN 1 THEN 'django' ELSE CASE WHEN page_id % 8 = 2 THEN 'axum' ELSE 'rust-binary' END END AS framework,
  CASE page_id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 ELSE CASE WHEN page_id % 8 = 2 THEN 0.93 ELSE 0.70 END END::DOUBLE AS confidence FROM pages WHERE page_id % 4 < 3""")
def entry_point_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest framework of each file that can start a program."""
    k = F.col("page_id")
    name = F.when(k % 4 == 0, "/pages/index.tsx").when(k % 4 == 1, "/manage.py").when(k % 4 == 2, "/src/main.rs").otherwise("/util.py")
    head = F.when(k % 8 == 2, "use axum::Router;\n").otherwise("fn main() {}\n")
    found = table(spark, sf_dir, "pages").select(_named("p", k, name).alias("path"), _named(head, F.coalesce("html", F.lit(""))).alias("content"))
    return code.ranked_entry_points(code.entry_points(found))


@query("SELECT 'd' || page_id || '/main.ts' AS path, './lib' || page_id AS source, 'd' || page_id || '/lib' || page_id || '.ts' AS target FROM pages WHERE page_id % 2 = 0")
def resolved_imports(spark, sf_dir):
    """Imports of whole files that lead to a file; every other file imports one that is not there."""
    k, rows = F.col("page_id"), table(spark, sf_dir, "pages")
    said = _named("import a from './lib", k, "'\n", F.coalesce("html", F.lit("")))
    mains = rows.select(_named("d", k, "/main.ts").alias("path"), said.alias("content"))
    there = rows.where(k % 2 == 0).select(_named("d", k, "/lib", k, ".ts").alias("path"))
    return code.resolved_imports(code.imports(mains), there.union(mains.select("path")))


@query("""SELECT 'f' || event_id AS path, CASE event_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END AS change FROM events
  UNION ALL SELECT 'g' || event_id, 'added' FROM events WHERE event_id % 4 = 2""")
def change_lines(spark, sf_dir):
    """A list of changed files by name and status; a rename is a deletion and an addition."""
    k = F.col("event_id")
    line = F.when(k % 4 == 0, _named("A\tf", k)).when(k % 4 == 1, _named("M\tf", k)).when(k % 4 == 2, _named("R100\tf", k, "\tg", k)).otherwise(_named("D\tf", k))
    return S.change_list(table(spark, sf_dir, "events").select(line.alias("value")))


@query(f"""SELECT doc_id, 2 AS n, CASE WHEN length(t) > 100 THEN substr(t, 1, 97) || '…' ELSE t END AS title, s AS content FROM (
  SELECT doc_id, s, regexp_replace(s, '[*_`]+$', '') AS t FROM (SELECT doc_id, 'first ' || {LINE} || '.' AS s FROM documents))""")
def learned_items(spark, sf_dir):
    """Items of the block of learnings in a page that holds the whole text."""
    page = _named("intro\n## Key Learnings\n- first ", _one_line(), ".\n2) second\n## Next\n- not this\n")
    found = table(spark, sf_dir, "documents").select("doc_id", M.learnings(page).alias("x"))
    return found.select("doc_id", F.size("x").alias("n"), F.col("x")[0]["title"].alias("title"), F.col("x")[0]["content"].alias("content"))


@query(f"SELECT doc_id, 'Plan ' || doc_id AS title, 'why' AS overview, 2 AS n, (doc_id % 9)::INT AS phase, 'body ' || {LINE} || '.' AS body FROM documents")
def plan_sections(spark, sf_dir):
    """Title, overview and first section of a plan that holds the whole text."""
    k = F.col("doc_id")
    page = _named("# Plan ", k, "\nwhy\n\n## Phase ", k % 9, ": store\nbody ", _one_line(), ".\n## Notes\nprose\n")
    found = table(spark, sf_dir, "documents").select("doc_id", M.plan(page).alias("x"))
    first = F.col("x.sections")[0]
    return found.select("doc_id", "x.title", "x.overview", F.size("x.sections").alias("n"), first["phase"].alias("phase"), first["body"].alias("body"))


@query("""SELECT doc_id, 'plan:' || coalesce(source, 'x') || ':' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '-the-body' || CASE WHEN doc_id % 3 > 0 THEN '--p0' || (doc_id % 3 + 1) ELSE '' END AS key,
  'lang:' || coalesce(lang, 'x') || ',status:' || coalesce(source, 'x') AS tags FROM documents""")
def plan_keys(spark, sf_dir):
    """Keys of a plan's sections and parts, and its tags with the status replaced."""
    k, at = F.col("doc_id"), F.coalesce("source", F.lit("x"))
    part = (k % 3 + 1).cast("int")
    key = M.part_key(M.section_key(at, k % 100, F.lit("The Body")), part, part)
    tags = M.with_tag(F.array(F.lit("status:draft"), F.concat(F.lit("lang:"), F.coalesce("lang", F.lit("x")))), "status:", at)
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), F.array_join(tags, ",").alias("tags"))

"""Heuristics over texts and pages taken as source files, inventories with ignore rules, and landmarks of DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ddl as D
from tessera.operators import heuristics as H
from tessera.operators import inventory as V

from .registry import query
from .tables import derived, table

#: code of each pattern and note, chosen by the id, with the whole text or page after it
SNIPPET = """CASE id % 17
  WHEN 0 THEN concat('// Keeps one connection for all', nl, 'private static instance: Db;', nl, 'export class DbPool', nl)
  WHEN 1 THEN concat('#!/usr/bin/env node', nl, nl, '// short', nl, 'export default function makeUserFactory() { return new Thing(); }', nl)
  WHEN 2 THEN concat('/** @description Injects things  ', nl, '@Injectable()', nl, 'export const MAX_ROWS = 5', nl, 'const MAX_RETRY_COUNT = 3;', nl)
  WHEN 3 THEN concat('bus.on("x", f); bus.Subscribe(g)', nl, '// hack: order matters', nl, 'a(); // eslint-disable-line @ts-ignore', nl)
  WHEN 4 THEN concat('stream.pipe(gzip)', nl, repeat(concat('// callers must always close', nl), 24))
  WHEN 5 THEN concat('class FastStrategy implements Plan {}', nl, 'impl<T: Clone> Store<T> for Disk<T> {', nl, '    impl fmt::Display for Disk {', nl)
  WHEN 6 THEN concat('app.use(auth); // Policy: every request is checked', nl)
  WHEN 7 THEN concat('@Guard canActivate()', nl, '# rule 7 is enforced', nl, '* never twice', nl)
  WHEN 8 THEN concat('repo.find(1); repo.save(x)', nl, repeat(concat('fn read_all()', nl, 'pub fn writeAllRows()', nl, 'def _hidden()', nl, 'def get_HTTPPage(x)', nl, 'fn new()', nl), 6))
  WHEN 9 THEN concat('jwt.verify(t)', nl, 'let LIMIT_X = 1', nl, 'pub const DEFAULT_SIZE_2: usize = 3;', nl)
  WHEN 10 THEN concat('bcrypt.hash(PassWord)', nl, repeat(concat('x // WARNING: slow', nl), 12))
  WHEN 11 THEN concat('escape(html)', nl) WHEN 12 THEN concat('cors({allow: 1})', nl) WHEN 13 THEN concat('helmet()', nl) WHEN 14 THEN concat('throttle(5)', nl)
  WHEN 15 THEN concat('   // Padded comment of some length   ', nl) ELSE '' END"""
PATH = "concat(CASE id % 3 WHEN 0 THEN 'src/models/m' WHEN 1 THEN 'src/Entity.' ELSE 'lib/f' END, CAST(id AS STRING), CASE id % 4 WHEN 0 THEN '' ELSE '.ts' END)"
FILES = "SELECT id, kind, {path} AS path, concat({snippet}, body) AS content FROM (SELECT *, chr(10) AS nl FROM (SELECT doc_id AS id, 'text' AS kind, text AS body FROM {documents} UNION ALL SELECT page_id, 'page', html FROM {pages}))"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), F.col("text").alias("body"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("body"))
    every = texts.union(pages).withColumn("nl", F.lit("\n"))
    return every.select("id", "kind", F.expr(PATH).alias("path"), F.concat(F.expr(SNIPPET), "body").alias("content"))


_FILES = FILES.format(path=PATH, snippet=SNIPPET, documents="documents", pages="pages")


def _meets(groups) -> str:
    return " AND ".join("(" + " OR ".join(f"contains(low, '{x}')" for x in g) + ")" for g in groups)


def _listed(table_) -> str:
    at = " AND (" + " OR ".join(f"contains(lower(path), '{p}')" for p in H.MODEL_PATHS) + ")"
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {_meets(g)}{at if n == 'Repository' else ''} THEN '{n}' END" for n, g in table_) + ")"


@query(f"SELECT kind, id, {_listed(H.PATTERNS)} AS patterns, {_listed(H.SECURITY)} AS security FROM (SELECT *, coalesce(lower(content), '') AS low FROM ({_FILES}))")
def file_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design patterns and security notes of whole texts and pages."""
    found = H.heuristics(files(spark, sf_dir))
    return found.select("kind", "id", F.array_join("patterns", "|").alias("patterns"), F.array_join("security", "|").alias("security"))


_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_LIMIT = f"^\\s*({'|'.join(H.DECLARATIONS)})(({'|'.join(H.LIMITS)})[A-Z_]*)"
_COMMENT = r"regexp_replace(regexp_replace(s, '^[/*#\s]+', ''), '\s+$', '')"


@query(f"""WITH f AS ({_FILES}), l AS (SELECT kind, id, path, content, string_split(regexp_replace(coalesce(content, ''), chr(10) || '$', ''), chr(10)) AS lines FROM f),
  e AS (SELECT kind, id, unnest(lines) AS s, generate_subscripts(lines, 1) AS k FROM l),
  n AS (SELECT kind, id, k, 1 AS o, 'r' AS what, 'Line ' || k || ': ' || {_COMMENT} AS note FROM e WHERE regexp_matches(s, '^\\s*(//|#|/\\*|\\*)') AND {_ANY('lower(s)', H.RULE_WORDS)} AND strlen({_COMMENT}) > 5
    UNION ALL SELECT kind, id, k, 2, 'r', regexp_extract(s, '{_LIMIT}', 2) || ' — constant' FROM e WHERE regexp_matches(s, '{_LIMIT}')
    UNION ALL SELECT kind, id, k, 1, 'g', 'Line ' || k || ': ' || regexp_replace(regexp_replace(s, '^\\s*/*\\s*', ''), '\\s+$', '') FROM e WHERE {_ANY('lower(s)', H.GOTCHAS)}
    UNION ALL SELECT kind, id, k, 2, 'g', 'Line ' || k || ': TS suppression' FROM e WHERE contains(lower(s), '@ts-ignore') OR contains(lower(s), '@ts-expect-error')
    UNION ALL SELECT kind, id, k, 3, 'g', 'Line ' || k || ': ESLint disabled' FROM e WHERE contains(lower(s), 'eslint-disable')),
  c AS (SELECT *, row_number() OVER (PARTITION BY kind, id, what ORDER BY k, o) AS nth FROM n),
  b AS (SELECT *, max(k) FILTER (nth = CASE what WHEN 'r' THEN {H.MOST_RULES} ELSE {H.MOST_GOTCHAS} END) OVER (PARTITION BY kind, id, what) AS last FROM c),
  g AS (SELECT kind, id, string_agg(note, chr(10) ORDER BY k, o) FILTER (what = 'r') AS rules, string_agg(note, chr(10) ORDER BY k, o) FILTER (what = 'g') AS gotchas FROM b WHERE last IS NULL OR k <= last GROUP BY 1, 2),
  m AS (SELECT kind, id, k, regexp_extract(s, '^\\s*(export (async )*(default )*(function |class |const )|pub fn |fn |def )([\\p{{L}}\\p{{N}}_]+)', 5) AS name, regexp_matches(s, '^\\s*def _') AS hidden FROM e),
  r AS (SELECT kind, id, string_agg(lower(replace(regexp_replace(name, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '_', ' ')), chr(10) ORDER BY k) AS responsibilities FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY k) AS nth FROM m WHERE name <> '' AND NOT hidden AND name NOT IN ({', '.join(f"'{b}'" for b in H.BOILERPLATE)})) WHERE nth <= {H.MOST_RESPONSIBILITIES} GROUP BY 1, 2),
  t AS (SELECT kind, id, string_agg(regexp_extract(s, '^\\s*impl(\\s*<[^>]*>)?\\s+([A-Za-z_][A-Za-z0-9_:]*)(\\s*<[^>]*>)?\\s+for\\s+([A-Za-z_][A-Za-z0-9_:]*)', 2) || ' for ' || regexp_extract(s, '^\\s*impl(\\s*<[^>]*>)?\\s+([A-Za-z_][A-Za-z0-9_:]*)(\\s*<[^>]*>)?\\s+for\\s+([A-Za-z_][A-Za-z0-9_:]*)', 4), chr(10) ORDER BY k) AS trait_impls
    FROM e WHERE regexp_matches(s, '^\\s*impl(\\s*<[^>]*>)?\\s+([A-Za-z_][A-Za-z0-9_:]*)(\\s*<[^>]*>)?\\s+for\\s+([A-Za-z_][A-Za-z0-9_:]*)') GROUP BY 1, 2),
  h AS (SELECT kind, id, path, trim(regexp_extract(substr(coalesce(content, ''), 1, 500), '@description([^\\n]*)', 1)) AS told, list_filter(list_transform(lines[1:10], lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: s <> '' AND NOT starts_with(s, '#!'))[1] AS first, regexp_extract(path, '[^/]*$') AS name FROM l)
  SELECT kind, id, CASE WHEN told <> '' THEN told WHEN starts_with(first, '//') AND strlen(regexp_replace(first, '^/+\\s*', '')) > 10 THEN regexp_replace(first, '^/+\\s*', '') ELSE regexp_replace(name, '(.)\\.[^.]*$', '\\1') END AS purpose,
    coalesce(responsibilities, '') AS responsibilities, coalesce(rules, '') AS rules, coalesce(gotchas, '') AS gotchas, coalesce(trait_impls, '') AS trait_impls
  FROM h LEFT JOIN g USING (kind, id) LEFT JOIN r USING (kind, id) LEFT JOIN t USING (kind, id)""")
def file_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purpose, responsibilities, rules, gotchas and trait implementations of whole texts and pages."""
    found = H.heuristics(files(spark, sf_dir))
    return found.select("kind", "id", "purpose", *(F.array_join(c, "\n").alias(c) for c in ("responsibilities", "rules", "gotchas", "trait_impls")))


#: a file for each page below its host and language, of every kind that rules speak of; and an ignore file for each host and each of its folders
LISTED = """SELECT page_id AS id, CASE WHEN page_id % 40 = 0 THEN 2000000 ELSE length(html) END AS size, concat(regexp_extract(url, '^[a-z]+://([^?#]*[^?#/])', 1), CASE page_id % 12 WHEN 0 THEN '/node_modules/x.js' WHEN 1 THEN '/app.min.js' WHEN 2 THEN '/.git/config'
  WHEN 3 THEN '/a.png' WHEN 4 THEN '/run.log' WHEN 5 THEN '/keep.log' WHEN 6 THEN '/drafts/one.md' WHEN 7 THEN '/drafts/keep.log' WHEN 8 THEN '/.env.example' WHEN 9 THEN '/deep/er/run.log' WHEN 10 THEN '/secret/x.txt' ELSE '.html' END) AS path FROM {pages}"""
RULES = """SELECT DISTINCT concat(host, '/.gitignore') AS path, concat('# notes', chr(10), '*.log', chr(10), '!keep.log', chr(10), CASE length(host) % 3 WHEN 0 THEN 'drafts/' WHEN 1 THEN '!run.log' ELSE '*.md' END) AS content FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM {pages})
  UNION ALL SELECT DISTINCT concat(folder, '/.gitignore'), concat('  !run.log  ', chr(10), '/keep.log', chr(10)) FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*/[a-z]+)/', 1) AS folder FROM {pages}) WHERE length(folder) % 2 = 0 AND folder <> ''
  UNION ALL SELECT DISTINCT concat(host, '/.scoutignore'), concat('keep.log', chr(10), 'secret', chr(10), 'en/1') FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM {pages})"""


@query(f"""WITH f AS ({LISTED.format(pages='pages')}), r AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, CASE WHEN ends_with(path, '.scoutignore') THEN 1 ELSE 2 END AS rank, unnest(string_split(content, chr(10))) AS s, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM ({RULES.format(pages='pages')})),
  u AS (SELECT folder, rank * 1000 + k AS nth, starts_with(trim(s), '!') AS keep, regexp_replace(regexp_replace(trim(s), '^!?/*', ''), '/+$', '') AS pattern FROM r WHERE trim(s) <> '' AND NOT starts_with(trim(s), '#')),
  p AS (SELECT *, string_split(path, '/') AS w FROM f), s AS (SELECT p.path, array_to_string(w[1:k], '/') AS node, w[k] AS name FROM p, range(1, 12) x(k) WHERE k <= len(w)),
  m AS (SELECT DISTINCT node, folder, nth, keep FROM s JOIN u ON (folder = '' OR starts_with(node, folder || '/')) AND CASE WHEN starts_with(pattern, '*') THEN ends_with(name, substr(pattern, 2)) WHEN contains(pattern, '/') THEN node = folder || '/' || pattern ELSE name = pattern END),
  d AS (SELECT node, keep FROM m QUALIFY row_number() OVER (PARTITION BY node ORDER BY length(folder) DESC, nth DESC) = 1),
  g AS (SELECT DISTINCT path FROM s JOIN d USING (node) WHERE NOT keep)
  SELECT id, path, size, regexp_extract(w[-1], '[^.]\\.([^.]*)$', 1) AS ext FROM p WHERE size <= 1048576 AND path NOT IN (SELECT path FROM g)
    AND len(list_filter(w, lambda x: x IN ({', '.join(f"'{n}'" for n in V.IGNORED_NAMES)}) OR regexp_matches(x, '\\.(min\\.js|min\\.css|map|lock)$') OR (starts_with(x, '.') AND x NOT IN ('.env.example', '.scoutignore')))) = 0
    AND regexp_extract(w[-1], '[^.]\\.([^.]*)$', 1) NOT IN ({', '.join(f"'{n}'" for n in V.BINARY)})""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below hosts and folders that have ignore files of their own."""
    made, rules = derived(spark, sf_dir, LISTED, "pages"), derived(spark, sf_dir, RULES, "pages")
    return V.listed(made, V.ignore_rules(rules)).select("id", "path", "size", "ext")


#: DDL before and after the whole text, the text itself as a comment or a default value, with what its id says
DDL = """SELECT doc_id AS id, concat(CASE doc_id % 5 WHEN 0 THEN concat('/* ', replace(text, '*/', ' '), ' */', nl) ELSE '' END,
  'CREATE TABLE IF NOT EXISTS app.t', e, ' (', nl, '  id BIGINT PRIMARY KEY, -- the key, (of course)', nl, '  price DECIMAL(10, ', v, ') NOT NULL DEFAULT (1 + (2)),', nl, '  "note" TEXT DEFAULT ''a, b', v, '(c''', nl,
  CASE doc_id % 3 WHEN 0 THEN concat(', state TEXT CHECK (state IN (''a'', ''b'')), owner', v, ' INT,', nl, ' FOREIGN KEY (owner', v, ') REFERENCES users (id)') WHEN 1 THEN ', CONSTRAINT fk FOREIGN KEY (a, b) REFERENCES other, UNIQUE (a, b)' ELSE ', PRIMARY KEY (id), CHECK (price > 0)' END, ');', nl,
  CASE doc_id % 5 WHEN 1 THEN concat('-- ', replace(text, nl, ' '), nl) ELSE '' END,
  CASE doc_id % 4 WHEN 0 THEN concat('ALTER TABLE t', e, ' ADD COLUMN c', v, ' varchar(', v, ') not null;') WHEN 1 THEN concat('alter table t', e, ' drop column c', v, ' cascade;')
    WHEN 2 THEN concat('ALTER TABLE t', e, ' ADD CONSTRAINT k FOREIGN KEY (x', v, ') REFERENCES app.z (id);') ELSE concat('ALTER TABLE t', e, ' RENAME TO u', v, ';') END, nl,
  'CREATE ', CASE WHEN doc_id % 2 = 0 THEN 'UNIQUE ' ELSE '' END, 'INDEX "ix_', e, '" ON t', e, ' (a', v, ', b);', nl, CASE WHEN doc_id % 5 > 1 THEN text ELSE '' END) AS content
  FROM (SELECT doc_id, coalesce(text, '') AS text, CAST(doc_id AS STRING) AS e, CAST(doc_id % 7 AS STRING) AS v, chr(10) AS nl FROM {documents})"""

_N = r'([A-Za-z_"][A-Za-z0-9_."]*)'
_FK = r"(?is)FOREIGN\s+KEY\s*\(([^)]+)\)\s*REFERENCES\s+" + _N + r"\s*(?:\(([^)]+)\))?"
_IX = r"(?is)CREATE\s+(UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _N + r"\s+ON\s+" + _N + r"\s*\(([^)]+)\)"
_TB = r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _N + r"\s*\(([^;]*?)\)\s*;"
_AL = r"(?is)ALTER\s+TABLE\s+" + _N + r"\s+([^;]+);"
#: parts of a body by a pattern that knows brackets three deep
_PART = r"(?:[^,()'']|''[^'']*''|\((?:[^()'']|''[^'']*''|\((?:[^()'']|''[^'']*''|\([^()]*\))*\))*\))+"


@query(f"""WITH b AS (SELECT id, regexp_replace(content, '(?s)--[^\\n]*|/\\*.*?(?:\\*/|$)', '', 'g') AS s FROM ({DDL.format(documents='documents')})),
  t AS (SELECT id, unnest(regexp_extract_all(s, '{_TB}', 1)) AS full_name, unnest(regexp_extract_all(s, '{_TB}', 2)) AS body FROM b),
  p AS (SELECT id, full_name, trim(unnest(regexp_extract_all(body, '{_PART}')), ' ' || chr(10)) AS part FROM t),
  a AS (SELECT id, unnest(regexp_extract_all(s, '{_AL}', 1)) AS full_name, trim(unnest(regexp_extract_all(s, '{_AL}', 2)), ' ' || chr(10)) AS body FROM b),
  i AS (SELECT id, unnest(regexp_extract_all(s, '{_IX}')) AS whole FROM b),
  x AS (SELECT id, 'table' AS kind, split_part(full_name, '.', 2) AS "table", NULL AS name, NULL AS type, split_part(full_name, '.', 1) AS detail, NULL AS ref_table, NULL AS ref_columns FROM t
    UNION ALL SELECT id, 'foreign_key', full_name, regexp_extract(part, '{_FK}', 1), NULL, NULL, regexp_extract(part, '{_FK}', 2), regexp_extract(part, '{_FK}', 3) FROM p WHERE regexp_matches(part, '^(FOREIGN KEY|CONSTRAINT .*FOREIGN KEY)')
    UNION ALL SELECT id, 'column', full_name, trim(regexp_extract(part, '(?s)^(\\S+)\\s+(\\S+)\\s*(.*)$', 1), '"'), regexp_extract(part, '(?s)^(\\S+)\\s+(\\S+)\\s*(.*)$', 2), regexp_extract(part, '(?s)^(\\S+)\\s+(\\S+)\\s*(.*)$', 3), NULL, NULL FROM p WHERE NOT regexp_matches(part, '^(FOREIGN KEY|CONSTRAINT |PRIMARY KEY|UNIQUE[ (]|CHECK[ (])')
    UNION ALL SELECT id, 'add_column', full_name, regexp_extract(upper(body), '^ADD COLUMN (\\S+)\\s+(\\S+)\\s*(.*)$', 1), regexp_extract(upper(body), '^ADD COLUMN (\\S+)\\s+(\\S+)\\s*(.*)$', 2), regexp_extract(upper(body), '^ADD COLUMN (\\S+)\\s+(\\S+)\\s*(.*)$', 3), NULL, NULL FROM a WHERE starts_with(upper(body), 'ADD COLUMN ')
    UNION ALL SELECT id, 'drop_column', full_name, regexp_extract(upper(body), '^DROP COLUMN (\\S+)', 1), NULL, NULL, NULL, NULL FROM a WHERE starts_with(upper(body), 'DROP COLUMN ')
    UNION ALL SELECT id, 'add_foreign_key', full_name, regexp_extract(body, '{_FK}', 1), NULL, NULL, regexp_extract(body, '{_FK}', 2), regexp_extract(body, '{_FK}', 3) FROM a WHERE starts_with(body, 'ADD CONSTRAINT')
    UNION ALL SELECT id, 'alter', full_name, NULL, NULL, body, NULL, NULL FROM a WHERE NOT regexp_matches(upper(body), '^(ADD|DROP)')
    UNION ALL SELECT id, CASE WHEN regexp_extract(whole, '{_IX}', 1) <> '' THEN 'unique_index' ELSE 'index' END, regexp_extract(whole, '{_IX}', 3), trim(regexp_extract(whole, '{_IX}', 2), '"'), NULL, regexp_extract(whole, '{_IX}', 4), NULL, NULL FROM i)
  SELECT * FROM x""")
def ddl_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that DDL around whole texts declares; commas within brackets, quotes and comments cut nothing."""
    return D.declarations(derived(spark, sf_dir, DDL, "documents")).drop("nth")

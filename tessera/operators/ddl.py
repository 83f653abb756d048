"""Tables, columns, keys, alterations and indexes that DDL in a text declares, in column expressions.

A table's body is cut at commas outside brackets and quotes: the body is read as quoted pieces, brackets, commas and the rest, and one
aggregate carries how many brackets are open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: statements and clauses
_NAME = r'([A-Za-z_"][\w\."]*)'
COMMENTS = r"(?s)--[^\n]*|/\*.*?(?:\*/|\z)"
TABLE = rf"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*\(([^;]*?)\)\s*;"
ALTER = rf"(?is)ALTER\s+TABLE\s+{_NAME}\s+([^;]+);"
INDEX = rf"(?is)CREATE\s+(UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s+ON\s+{_NAME}\s*\(([^)]+)\)"
FOREIGN_KEY = rf"(?is)FOREIGN\s+KEY\s*\(([^)]+)\)\s*REFERENCES\s+{_NAME}\s*(?:\(([^)]+)\))?"
TABLE_RULES = r"(?i)^(PRIMARY KEY|UNIQUE[ (]|CHECK[ (])"
_PIECES = r"""(?s)'(?:[^']|'')*'|"[^"]*"|[(),]|[^(),'"]+|['"]"""
_FIELDS = ("kind", "table", "name", "type", "detail", "ref_table", "ref_columns")


def without_comments(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), COMMENTS, "")


def split_top_level(body: Column) -> Column:
    """Parts of a body between commas that stand outside brackets and quotes, trimmed; empty ones go."""
    pieces = F.regexp_extract_all(body, F.lit(_PIECES), F.lit(0))
    start = F.struct(F.lit(0).alias("open"), F.lit("").alias("part"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, p: Column) -> Column:
        cut = (p == ",") & (s.open == 0)
        depth = F.when(p == "(", s.open + 1).when(p == ")", F.greatest(s.open - 1, F.lit(0))).otherwise(s.open)
        return F.struct(depth.alias("open"), F.when(cut, F.lit("")).otherwise(F.concat(s.part, p)).alias("part"), F.when(cut, F.array_append(s.done, s.part)).otherwise(s.done).alias("done"))

    parts = F.aggregate(pieces, start, step, lambda s: F.array_append(s.done, s.part))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def _row(kind: str, table: Column, **more: Column) -> Column:
    given = {"kind": F.lit(kind), "table": table} | more
    return F.struct(*(given.get(f, F.lit(None)).cast("string").alias(f) for f in _FIELDS))


def _unquoted(name: Column) -> Column:
    return F.regexp_replace(name, '^"+|"+$', "")


def _column(kind: str, table: Column, text: Column) -> Column:
    """A column from its name, type and the rest; null if it has no type."""
    pattern = r"(?s)^(\S+)\s+(\S+)\s*(.*)$"
    pick = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), _row(kind, table, name=_unquoted(pick(1)), type=pick(2), detail=pick(3)))


def _key(kind: str, table: Column, text: Column) -> Column:
    pick = lambda k: F.trim(F.regexp_extract(text, FOREIGN_KEY, k))
    return _row(kind, table, name=pick(1), ref_table=pick(2), ref_columns=pick(3))


def declared(text: Column) -> Column:
    """``array<struct<kind, table, name, type, detail, ref_table, ref_columns>>`` of all that a text declares; comments do not count.

    Kinds are table (detail: its schema), column, foreign_key (name: its columns), add_column and drop_column (in upper case), add_foreign_key, alter
    (detail: what else it says), index and unique_index (name: the index, detail: its columns). Runs of white space part a column's words. Null and empty texts declare nothing.
    """
    pick = lambda pattern, k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))

    def of_table(x: Column) -> Column:
        full = _unquoted(x.full)
        own = F.when(full.contains("."), _row("table", _unquoted(F.regexp_replace(full, r"^[^.]*\.", "")), detail=_unquoted(F.regexp_extract(full, r"^([^.]*)\.", 1)))).otherwise(_row("table", full))
        keyed = r"(?is)^(FOREIGN KEY|CONSTRAINT .*FOREIGN KEY)"
        part = lambda p: F.when(p.rlike(keyed) & p.rlike(FOREIGN_KEY), _key("foreign_key", x.full, p)).when(~p.rlike(TABLE_RULES), _column("column", x.full, p))
        return F.concat(F.array(own), F.array_compact(F.transform(split_top_level(x.body), part)))

    def of_alter(x: Column) -> Column:
        body = F.regexp_replace(x.body, r"^\s+|\s+$", "")
        upper = F.upper(body)
        added, dropped = F.regexp_extract(upper, r"(?s)^ADD COLUMN (.*)$", 1), F.regexp_extract(upper, r"^DROP COLUMN \s*(\S+)", 1)
        return (
            F.when(upper.startswith("ADD COLUMN "), _column("add_column", x.full, added))
            .when(upper.startswith("DROP COLUMN "), _row("drop_column", x.full, name=dropped))
            .when(upper.startswith("ADD CONSTRAINT") & upper.contains("FOREIGN KEY"), F.when(body.rlike(FOREIGN_KEY), _key("add_foreign_key", x.full, body)))
            .otherwise(_row("alter", x.full, detail=body))
        )

    of_index = lambda s: F.when(F.regexp_extract(s, INDEX, 1) != "", F.lit("unique_index")).otherwise("index")
    two = lambda pattern: F.arrays_zip(pick(pattern, 1).alias("full"), pick(pattern, 2).alias("body"))
    indexes = F.transform(pick(INDEX, 0), lambda s: F.struct(
        of_index(s).alias("kind"), _unquoted(F.regexp_extract(s, INDEX, 3)).alias("table"), _unquoted(F.regexp_extract(s, INDEX, 2)).alias("name"), F.lit(None).cast("string").alias("type"),
        F.trim(F.regexp_extract(s, INDEX, 4)).alias("detail"), F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("string").alias("ref_columns"),
    ))
    return F.concat(F.flatten(F.transform(two(TABLE), of_table)), F.array_compact(F.transform(two(ALTER), of_alter)), indexes)


def declarations(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``files`` without the content, a row for each declaration, in order (``nth`` from 0)."""
    kept = [c for c in files.columns if c != content_col]
    bare = files.select(*kept, without_comments(F.col(content_col)).alias("__bare")).where(F.col("__bare").rlike(r"(?i)\b(CREATE|ALTER)\s"))
    return bare.select(*kept, F.posexplode(declared(F.col("__bare"))).alias("nth", "x")).select(*kept, "nth", "x.*")


def migration(path: Column) -> Column:
    """``struct<sequence, name>`` of a migration's file name: its leading digits and what follows them."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.sql)+$", "")
    digits = F.regexp_extract(name, r"^[0-9]*", 0)
    rest = F.regexp_replace(name, r"^[0-9]*[_-]*", "")
    return F.struct(F.nullif(digits, F.lit("")).alias("sequence"), F.when(digits == "", name).otherwise(F.nullif(rest, F.lit(""))).alias("name"))

"""Tagged JSON lines, logs of tab-separated values, directory inventories and change lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import text as T
from tessera.operators.inventory import MOST_BYTES, listed


def tagged_lines(entries: DataFrame, edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """One JSON line a row, ``{"kind": ..., "data": {...}}``; an edge only if both ends are exported."""
    ids = entries.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")

    def lines(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*rows.columns).alias("data"))).alias("value"))

    return lines(entries, "entry").union(lines(inside, "edge")).union(lines(sessions, "session"))


def parse_tagged(lines: DataFrame, schema: StructType, kind: str = "entry") -> DataFrame:
    """Rows of one kind from a column ``value`` of JSON lines; a bare object without kind is an entry; bad lines go."""
    tag = F.get_json_object("value", "$.kind")
    data = F.when(tag.isNull(), F.col("value")).otherwise(F.get_json_object("value", "$.data"))
    row = F.from_json(data, schema, {"mode": "PERMISSIVE"})
    return lines.where((F.coalesce(tag, F.lit("entry")) == kind)).select(row.alias("r")).where("r.id is not null").select("r.*")


def bad_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").isNotNull() & (F.trim("value") != "") & ~T.is_json(F.col("value")))


def absent_only(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert if absent: incoming rows with a new id, one of each."""
    return incoming.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


def inventory(spark: SparkSession, path: str, rules: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, size, lines, modified, ext, hash) of the text files below a folder that an inventory lists; paths are relative.

    ``rules`` is what :func:`tessera.operators.inventory.ignore_rules` makes of ignore files; Spark's own readers do not list hidden files, so their texts are the
    caller's to read. Names and sizes decide before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    whole = F.regexp_replace("path", "^[a-z]+:/+", "/")
    inside = F.substring(whole, len(path.rstrip("/")) + 2, 1 << 20)
    found = listed(files.select(inside.alias("path"), F.col("length").alias("size"), "content", F.col("modificationTime").alias("modified")), rules, most_bytes)
    lines = F.size(F.split(F.decode("content", "utf-8"), "\n"))
    return found.select("path", "size", lines.alias("lines"), "modified", F.concat(F.lit("."), "ext").alias("ext"), F.sha2("content", 256).alias("hash"))


def change_list(lines: DataFrame) -> DataFrame:
    """``value`` of name-status lines -> (path, change): A, M, D and R, a rename being a deletion and an addition."""
    part = F.split("value", "\t")
    code = F.substring(part[0], 1, 1)
    names = {"A": "added", "M": "modified", "D": "deleted"}
    single = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    rows = F.when(
        code == "R", F.array(F.struct(part[1].alias("path"), F.lit("deleted").alias("change")), F.struct(F.get(part, F.lit(2)).alias("path"), F.lit("added").alias("change")))
    ).otherwise(F.array(F.struct(part[1].alias("path"), single[code].alias("change"))))
    return lines.where(F.size(part) > 1).select(F.explode(rows).alias("x")).select("x.*").where("change is not null")


def log_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``value``: a line of tab-separated columns for each row; nulls at its end are left out, so narrow rows stay narrow.

    Tabs and line ends within a value become blanks, nulls before the last value are empty.
    """
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in columns]
    last = F.greatest(*(F.when(F.col(c).isNotNull(), k + 1).otherwise(0) for k, c in enumerate(columns)), F.lit(0))
    return rows.select(F.array_join(F.slice(F.array(*clean), F.lit(1), last), "\t").alias("value"))


def parsed_log(lines: DataFrame, columns: list[tuple[str, str]], least: int) -> DataFrame:
    """``value`` -> the columns by name and type, ``width`` and ``fault``: rows of every width in one read.

    Columns that a narrow row lacks are null, an empty field is null too. ``fault`` tells what is wrong, with all columns null: fewer than ``least`` fields, or a field among
    the first ``least`` that its type cannot hold. A later field of the wrong type is null and no fault; fields beyond the known ones are left out. Empty lines go.
    """
    parts = F.split(F.regexp_replace("value", r"\r$", ""), "\t", -1)
    held = lines.where(F.col("value").isNotNull() & (F.trim("value") != "")).select(parts.alias("parts")).withColumn("width", F.size("parts"))
    raw = [F.nullif(F.get("parts", F.lit(k)), F.lit("")) for k in range(len(columns))]
    read = held.select("width", *(r.alias(f"__{n}") for r, (n, _) in zip(raw, columns, strict=True)))
    cast = [F.col(f"__{n}").try_cast(t) for n, t in columns]
    wrong = F.coalesce(*(F.when(F.col(f"__{n}").isNull() | c.isNull(), F.lit(f"bad {n}")) for c, (n, _) in zip(cast[:least], columns[:least], strict=True)))
    fault = F.when(F.col("width") < least, "too few fields").otherwise(wrong)
    return read.select(*(F.when(fault.isNull(), c).alias(n) for c, (n, _) in zip(cast, columns, strict=True)), "width", fault.alias("fault"))


def stats_log(spark: SparkSession, path: str, columns: list[tuple[str, str]], least: int = 3) -> DataFrame:
    """:func:`parsed_log` of the text files at ``path``."""
    return parsed_log(spark.read.text(path), columns, least)


def append_log(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Append rows to a log as new files."""
    log_lines(rows, columns).write.mode("append").text(path)


def line_faults(lines: DataFrame) -> DataFrame:
    """``value`` of tagged JSON lines -> (fault, n): what an import leaves out, and why."""
    kind, text = F.get_json_object("value", "$.kind"), F.trim("value")
    data = F.when(kind.isNull(), F.col("value")).otherwise(F.get_json_object("value", "$.data"))
    fault = (
        F.when(F.col("value").isNull() | (text == ""), "empty").when(~T.is_json(F.col("value")), "no JSON").when(~text.startswith("{"), "no object")
        .when(kind.isNotNull() & ~kind.isin("entry", "edge", "session"), "unknown kind").when(F.get_json_object(data, "$.id").isNull(), "no id")
    )
    return lines.select(fault.alias("fault")).where("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))

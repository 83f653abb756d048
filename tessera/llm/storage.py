"""Intermediate tables in the folder that driver and executors share.

A table written here cuts the lineage: losing an executor costs only the tasks that
were running, and no step is computed twice because two later steps read it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folder: str | None = None
#: tables written by :func:`materialize` in this session, in order
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder where none is set (local tests)."""
    global _local_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_folder = _local_folder or tempfile.mkdtemp(prefix="tessera-")
        base = f"file://{_local_folder}"
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back from there."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    _written.append(path)
    return out


def mark() -> int:
    """A point in the run, for :func:`discard_since`."""
    return len(_written)


def discard_since(point: int, spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Delete every intermediate table written since ``point`` but ``keep``, once a step's own result is written."""
    last = getattr(keep, "_tessera_path", None)
    for path in _written[point:]:
        if path != last:
            _delete(spark, path)
    _written[point:] = [last] if last in _written[point:] else []


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a table from :func:`materialize` that nothing will read again."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing holds any more.

    The cleaner acts when the driver's JVM collects garbage, which a driver with little to
    do may not do for an hour; a long chain of steps calls this between them. Listeners hold
    the plan of the last query they were told of, so a query without shuffle goes before.
    """
    gc.collect()
    spark.sql("select 1").collect()
    spark._jvm.System.gc()


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(u, id, raw)``: UTF-8 texts (null: empty) with ``u`` rising with (id, null last; text).

    ``u`` is distinct even where ids repeat, so it orders documents and joins rows to their own text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8").alias("raw"))
    place = [F.col("id").asc_nulls_last(), F.xxhash64("raw").asc()]
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place, "raw")
    texts = materialize(ordered.select(F.monotonically_increasing_id().alias("u"), "id", "raw"), "zstd")
    release(docs.sparkSession)
    return texts

"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame functions only.

Each row goes to one of R runs by a hash of its id. A run is written sorted by digest and holds one entry for each
digest: the smallest id and the number of copies. Then come log2(R) binomial rounds. In round k the runs whose numbers
differ in bit k exchange halves: entries whose digest has bit k unset meet in the one, the others in the
other. What meets is merged in digest order, smallest id first: the first entry of each digest stays, and carries
the copies of all. After the last round every run holds one part of the digests, of all rows.

Texts count as equal only if SHA-256, a second 64-bit hash and the byte length all agree, at every level. A digest
that a third of all rows carry has at most one entry for each run after the first combine and at most two in a
merge, so no key gathers many rows anywhere: the way back down joins the last runs to the first ones on the
digest, and those to the rows on (run, digest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

SPACE = "[\\x20\\x09-\\x0D]+"
KEY = ["digest", "second", "n_bytes"]


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _runs(df: DataFrame, least: int = 16) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(least - 1, parts - 1).bit_length()


def merged_runs(runs: DataFrame, n_runs: int) -> DataFrame:
    """``runs(run, digest, second, n_bytes, keep_id, copies)``, one entry of a digest in a run -> one entry of a digest."""
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    for k in range(n_runs.bit_length() - 1):
        bit = F.lit(1 << k)
        at = (F.col("run") - F.col("run").bitwiseAND(bit)).bitwiseOR(head.bitwiseAND(bit)).cast("int")
        merge = Window.partitionBy("run", *KEY).orderBy(F.asc_nulls_last("keep_id"))
        runs = (
            runs.withColumn("run", at)
            .withColumn("place", F.row_number().over(merge))
            .withColumn("copies", F.sum("copies").over(merge.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .where("place = 1")
            .drop("place")
        )
    return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``runs`` is a power of two. Null text is the empty text. A null id sorts after all others: it is kept only if its
    group has no other id. Of repeated rows with one id and equal text, one is kept. Other
    columns are ignored, whatever their names. An empty table gives an empty table.
    """
    n_runs = runs or _runs(docs)
    if n_runs & (n_runs - 1):
        raise ValueError("runs is a power of two")
    text = normalised(F.col(text_col).cast("string"))
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), text.alias("t"))
        .select(
            "id",
            F.unhex(F.sha2("t", 256)).alias("digest"),
            F.xxhash64("t").alias("second"),
            F.octet_length("t").alias("n_bytes"),
            F.pmod(F.xxhash64("id"), F.lit(n_runs)).cast("int").alias("run"),
        )
    )
    entries = rows.groupBy("run", *KEY).agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))
    first = materialize(entries.sortWithinPartitions("run", *KEY))
    known = first.select("run", *KEY).join(merged_runs(first, n_runs).drop("run"), KEY)
    same = Window.partitionBy("run", *KEY, "id").orderBy(F.lit(1))
    return (
        rows.join(known, ["run", *KEY])
        .withColumn("nth", F.row_number().over(same))
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            F.col("copies").alias("group_size"),
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Rows that share an id but not a text each stay. Repeated rows with one id and equal text are one document: they are
    cut to one a task before the shuffle, and one of them stays. An empty table gives an empty table.
    """
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.col("__sha"))
    kept = exact_dedup(docs, id_col, text_col).where("kept").withColumnRenamed("text_sha256", "__sha")
    marks = kept.select(key.alias("__key"))
    once = Window.partitionBy("__key").orderBy(F.lit(1))
    return (
        docs.withColumn("__sha", F.sha2(normalised(F.col(text_col).cast("string")), 256))
        .withColumn("__key", key)
        .withColumn("__nth", F.row_number().over(once))
        .where(F.col("__nth") <= 1)
        .join(marks, "__key", "left_semi")
        .select(*docs.columns)
    )

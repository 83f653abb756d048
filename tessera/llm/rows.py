"""Rows by what they hold: ids may repeat with other texts, so a decision goes to (id, text), never to an id alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    """64 bits of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def row_key(id_: Column, hash_: Column) -> Column:
    """Key of a row, null ids included."""
    return F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), hash_.cast("string"))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows keyed in ``gone(key)``, and one of each set of rows equal in id and text; rows without id stay.

    Rows that repeat are cut to one a task before anything is shuffled, so no key gathers many of them;
    the join then reads the same partitioning.
    """
    known = F.col(id_col).isNotNull()
    once = Window.partitionBy("__key").orderBy(F.lit(1))
    keyed = docs.where(known).withColumn("__key", row_key(F.col(id_col), text_hash(F.col(text_col))))
    single = keyed.withColumn("__nth", F.row_number().over(once)).where(F.col("__nth") <= 1)
    left = single.join(gone.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti").select(*docs.columns)
    return left.union(docs.where(~known))

"""Change logs: coalescing, conflicts, cursors, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesced(changes: DataFrame, key: str = "entry_id", time: str = "created_at", tie: str = "id") -> DataFrame:
    """The latest change of each key and the number of older ones that it stands for.

    Equal times: the smaller tie column stays. Aggregated by key, so a busy key combines before the shuffle.
    """
    payload = F.struct(*(c for c in changes.columns if c != key))
    best = F.struct(F.col(time), (-F.col(tie)).alias("down"))
    got = changes.groupBy(key).agg(F.max_by(payload, best).alias("row"), (F.count("*") - 1).alias("subsumed"))
    return got.select(key, "row.*", "subsumed")


def resolution(local: str = "l", remote: str = "r") -> Column:
    """struct(action, audited) for a row of aliases with updated_at, verified and deleted_at; local may be absent."""
    col = lambda side, c: F.col(f"{side}.{c}")
    gone, back = col(local, "deleted_at").isNotNull(), col(remote, "deleted_at").isNull()
    lv, rv = col(local, "verified"), col(remote, "verified")
    action = (
        F.when(col(local, "id").isNull(), "insert")
        .when(gone & back, "skip")
        .when(~gone & ~back, "update")
        .when(lv & ~rv, "skip")
        .when(~lv & rv, "update")
        .when(col(remote, "updated_at") > col(local, "updated_at"), "update")
        .otherwise("skip")
    )
    audited = col(local, "id").isNotNull() & ((gone & back) | ((gone == ~back) & lv & ~rv))
    return F.struct(action.alias("action"), F.coalesce(audited, F.lit(False)).alias("audited"))


def merged(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, action, audited) for every incoming row."""
    joined = incoming.alias("r").join(local.alias("l"), F.col("l.id") == F.col("r.id"), "left")
    return joined.select(F.col("r.id").alias("id"), resolution().alias("x")).select("id", "x.*")


def applied(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """The local table after the incoming rows that win."""
    wins = merged(local, incoming).where("action <> 'skip'").select("id")
    new = incoming.join(wins, "id", "left_semi")
    return local.join(new.select("id"), "id", "left_anti").unionByName(new)


def change_page(entries: DataFrame, cursor: Column, now: Column, limit: int = 500, skew_seconds: int = 2) -> DataFrame:
    """Rows updated after the cursor and not within the clock skew of now, tombstones too, oldest first."""
    t = F.col("updated_at")
    return entries.where((t > cursor) & (t <= now - F.expr(f"interval {skew_seconds} seconds"))).orderBy("updated_at", "id").limit(limit)


def missing_deletes(entries: DataFrame, outbox: DataFrame) -> DataFrame:
    """Deleted rows that the log knows, but not as deleted."""
    gone = entries.where("deleted_at is not null")
    known = outbox.select(F.col("entry_id").alias("id"))
    return gone.join(known.distinct(), "id", "left_semi").join(outbox.where("op_kind = 'delete'").select(F.col("entry_id").alias("id")).distinct(), "id", "left_anti")


def queue_health(rows: DataFrame, dead_after: int = 10) -> DataFrame:
    """Pending, in flight and dead rows, oldest and newest, in one pass."""
    dead = F.col("attempts") >= dead_after
    open_ = F.col("confirmed_at").isNull()
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(
        n(open_ & ~dead & F.col("claimed_at").isNull()).alias("pending"), n(open_ & ~dead & F.col("claimed_at").isNotNull()).alias("in_flight"),
        n(open_ & dead).alias("dead"), F.min(F.when(open_, F.col("created_at"))).alias("oldest"), F.max(F.when(open_, F.col("created_at"))).alias("newest"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, hash)."""
    a, b = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def affected(changes: DataFrame, imports: DataFrame) -> DataFrame:
    """Changed paths and, for those not new, the files that import them; one hop, distinct."""
    stale = changes.where("change <> 'added'").select(F.col("path").alias("target"))
    importers = imports.join(stale, "target", "left_semi").select(F.col("source").alias("path"))
    return changes.select("path").union(importers).distinct()


def outbox_step(rows: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Confirmed rows get a time, failed ones one more attempt and their claim released; ``results(id, ok)``."""
    out = rows.join(results.select("id", "ok"), "id", "left")
    return (
        out.withColumn("confirmed_at", F.when(F.col("ok"), now).otherwise(F.col("confirmed_at")))
        .withColumn("attempts", F.col("attempts") + F.coalesce((~F.col("ok")).cast("int"), F.lit(0)))
        .withColumn("claimed_at", F.when(~F.coalesce("ok", F.lit(True)), F.lit(None)).otherwise(F.col("claimed_at")))
        .select(*rows.columns)
    )


def first_claims(rows: DataFrame, most: int) -> DataFrame:
    """The oldest unclaimed, unconfirmed rows."""
    return rows.where("claimed_at is null and confirmed_at is null").orderBy("created_at", "id").limit(most)


def latest_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")

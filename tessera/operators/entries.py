"""Lookups in, and writes to, a table of entries. Writes return the changed table; time is an argument.

Entries: id, namespace, title, content, type, source, tags, project_id, topic_key, author, layer,
access_count, injected_count, confidence, verified, content_hash, created_at, updated_at,
last_accessed_at, deleted_at (null: live); a query uses those it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_hash


def live(entries: DataFrame) -> DataFrame:
    return entries.where("deleted_at is null")


def by_ids(entries: DataFrame, ids: DataFrame, with_deleted: bool = False) -> DataFrame:
    return (entries if with_deleted else live(entries)).join(ids.select("id").distinct(), "id", "left_semi")


def latest_by_key(entries: DataFrame) -> DataFrame:
    """The newest live row of each (namespace, topic_key)."""
    newest = Window.partitionBy("namespace", "topic_key").orderBy(F.desc("created_at"), F.desc("id"))
    return live(entries).where("topic_key is not null").withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def by_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Live rows whose key starts with the prefix, taken literally."""
    return live(entries).where(F.col("topic_key").startswith(prefix))


def page(entries: DataFrame, namespace: str, kind: str | None = None, with_deleted: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = (entries if with_deleted else live(entries)).where(F.col("namespace") == namespace)
    return (rows.where(F.col("type") == kind) if kind else rows).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def by_author(found: DataFrame, part: str) -> DataFrame:
    """Of a page already cut to its limit, rows whose author holds the part in any case."""
    return found.where(F.lower("author").contains(part.lower()))


def timeline(entries: DataFrame, centre_id, hours: int = 24, newest: int = 50) -> DataFrame:
    """Rows of the centre's namespace within the hours on either side, of the namespace's newest rows."""
    centre = live(entries).where(F.col("id") == centre_id).select(F.col("namespace").alias("ns"), F.col("created_at").alias("t"))
    recent = (
        live(entries).join(F.broadcast(centre), F.col("namespace") == F.col("ns"))  # one row
        .orderBy(F.desc("created_at"), "id").limit(newest)
    )
    window = F.expr(f"interval {hours} hours")
    return recent.where(F.col("created_at").between(F.col("t") - window, F.col("t") + window)).drop("ns", "t")


def never_used(entries: DataFrame, before: Column) -> DataFrame:
    """Stale rows of the crawler: not verified, never used, created before the cutoff."""
    return live(entries).where((F.col("source") == "scout") & ~F.col("verified") & (F.col("access_count") == 0) & F.col("last_accessed_at").isNull() & (F.col("created_at") < before))


def evictable(entries: DataFrame, before: Column, below: float) -> DataFrame:
    idle = F.coalesce("last_accessed_at", "created_at") < before
    return live(entries).where((F.col("layer") == 4) & ~F.col("verified") & (F.col("access_count") == 0) & (F.col("confidence") < below) & idle)


def purgeable(entries: DataFrame, before: Column) -> DataFrame:
    return entries.where(F.col("deleted_at") < before)


# -- writes --


def saved(batch: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """What saving a batch does to each of its rows: (id, action, supersedes).

    A row whose hash is live in its namespace, or came earlier in the batch, is a ``duplicate``; a row whose
    key is live, or came earlier, is ``updated`` and supersedes the newest row of that key; else ``created``.
    """
    old = live(entries).select("id", "namespace", "topic_key", content_hash(F.col("title"), F.col("content")).alias("hash"), "created_at", F.lit(0).alias("batch"))
    new = batch.select("id", "namespace", "topic_key", content_hash(F.col("title"), F.col("content")).alias("hash"), now.alias("created_at"), F.lit(1).alias("batch"))
    order = [F.col("batch"), F.col("created_at"), F.col("id")]
    same = Window.partitionBy("namespace", "hash").orderBy(*order)
    rows = old.union(new).withColumn("copy", F.row_number().over(same) > 1)
    before = Window.partitionBy("namespace", "topic_key").orderBy(*order)
    kept = rows.where((F.col("batch") == 0) | ~F.col("copy"))
    # only rows with a key can supersede: the others never meet in a window
    keyed = kept.where("topic_key is not null").withColumn("supersedes", F.lag("id").over(before)).where("batch = 1")
    written = keyed.select("id", F.when(F.col("supersedes").isNull(), "created").otherwise("updated").alias("action"), "supersedes")
    none = F.lit(None).cast(written.schema["supersedes"].dataType)
    loose = kept.where("topic_key is null and batch = 1").select("id", F.lit("created"), none)
    return written.union(loose).union(rows.where("batch = 1 and copy").select("id", F.lit("duplicate"), none))


def patched(entries: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Rows with the patch's non-null title, content, tags, layer, access_count and last_accessed_at.

    updated_at moves where a patch exists, and the stored hash follows title and content.
    """
    fields = [c for c in ("title", "content", "tags", "layer", "access_count", "last_accessed_at") if c in patches.columns and c in entries.columns]
    p = patches.select("id", *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(True).alias("hit"))
    out = entries.join(p, "id", "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"new_{c}", c))
    out = out.withColumn("updated_at", F.when(F.col("hit"), now).otherwise(F.col("updated_at")))
    if "content_hash" in entries.columns:
        out = out.withColumn("content_hash", F.when(F.col("hit"), content_hash(F.col("title"), F.col("content"))).otherwise(F.col("content_hash")))
    return out.select(*entries.columns)


def touched(entries: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """One more access, and out of the deeper layers, for each of the ids that is live."""
    hit = F.col("hit") & F.col("deleted_at").isNull()
    out = entries.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return (
        out.withColumn("access_count", F.col("access_count") + F.col("hit").cast("int"))
        .withColumn("last_accessed_at", F.when(F.col("hit"), now).otherwise(F.col("last_accessed_at")))
        .withColumn("layer", F.when(F.col("hit"), F.least("layer", F.lit(2))).otherwise(F.col("layer")))
        .select(*entries.columns)
    )


def deleted(entries: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    marked = entries.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return marked.withColumn("deleted_at", F.when(F.col("hit"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).select(*entries.columns)


def namespaces_merged(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Live entries, or all sessions (rows without tombstones), of one namespace in another; the same name changes nothing."""
    here = F.col("namespace") == source
    move = here & F.col("deleted_at").isNull() if "deleted_at" in rows.columns else here
    return rows.withColumn("namespace", F.when(move, F.lit(target)).otherwise(F.col("namespace")))


def merge_preview(entries: DataFrame, sessions: DataFrame, source: str, target: str) -> DataFrame:
    """(namespace, entries, sessions) that a merge of the two namespaces would touch."""
    both = F.col("namespace").isin(source, target)
    a = live(entries).where(both).groupBy("namespace").agg(F.count("*").alias("entries"))
    b = sessions.where(both).groupBy("namespace").agg(F.count("*").alias("sessions"))
    return a.join(b, "namespace", "full_outer").select("namespace", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "sessions")))


def next_layer(now: Column) -> Column:
    """The layer a row moves to, or null: first rule that fits."""
    days = F.floor(F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds(F.coalesce("last_accessed_at", "created_at"))) / 86400)
    layer = F.col("layer")
    limit = F.when(layer == 1, 7).when(layer == 2, 14).when(layer == 3, 30)
    return (
        F.when(F.col("verified") & (layer == 1), 3)
        .when((F.col("access_count") >= 5) & (layer < 3), layer + 1)
        .when((F.col("confidence") < 0.5) & (layer < 4) & (days >= 2 * limit), 4)
        .when(days >= limit, layer + 1)
    )


def transitions(entries: DataFrame, now: Column, newest: int | None = 500) -> DataFrame:
    """(id, layer, next_layer) of the newest live rows that change layer."""
    rows = live(entries)
    rows = rows.orderBy(F.desc("created_at"), "id").limit(newest) if newest else rows
    return rows.withColumn("next_layer", next_layer(now)).where("next_layer is not null and next_layer <> layer").select("id", "layer", "next_layer")


# -- copies --


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """Live rows that share (namespace, hash) with another one, with their group's size and the row to keep.

    Most used, verified, newest stays. Both are aggregated with map-side combining in one pass and joined back, so a
    hash that very many rows carry is combined before it is shuffled and the join can split it.
    """
    rows = live(entries).withColumn("hash", content_hash(F.col("title"), F.col("content")))
    rank = F.struct("access_count", "verified", "created_at", (-F.col("id")).alias("down"))
    groups = rows.groupBy("namespace", "hash").agg(F.count("*").alias("copies"), F.max_by("id", rank).alias("keep_id")).where("copies > 1")
    return rows.join(groups, ["namespace", "hash"])


def keepers(entries: DataFrame) -> DataFrame:
    """(id, keep_id) of every row in a duplicate group."""
    return duplicate_groups(entries).select("id", "keep_id")

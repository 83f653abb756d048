"""Writes over entries, edges, sessions and logs beyond the plain save: each returns the changed tables or the rows to append.

Time is an argument. A write that touches a stated set of ids is one left join with the distinct ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.redact import redacted_rows
from tessera.functions.text import bounded, content_hash, without_private

from .entries import live, saved

MOST_CHARS = 10_000


def _hit(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    marks = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    return rows.join(marks, key, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def injected(entries: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """One more injection for each of the ids that is live; updated_at does not move."""
    rows = _hit(entries, ids)
    hit = F.col("__hit") & F.col("deleted_at").isNull()
    out = rows.withColumn("injected_count", F.col("injected_count") + hit.cast("int"))
    if "last_injected_at" in entries.columns:
        out = out.withColumn("last_injected_at", F.when(hit, now).otherwise(F.col("last_injected_at")))
    return out.select(*entries.columns)


def verified(entries: DataFrame, ids: DataFrame, by: str, now: Column) -> DataFrame:
    """Live rows of the ids become verified, with who and when."""
    rows = _hit(entries, ids)
    hit = F.col("__hit") & F.col("deleted_at").isNull()
    when = lambda new, c: F.when(hit, new).otherwise(F.col(c)) if c in entries.columns else F.when(hit, new)
    keep = [c for c in entries.columns if c not in ("verified", "verified_by", "verified_at")]
    return rows.select(*keep, when(F.lit(True), "verified").alias("verified"), when(F.lit(by), "verified_by").alias("verified_by"), when(now, "verified_at").alias("verified_at"))


def retagged(entries: DataFrame, tags: DataFrame) -> DataFrame:
    """``tags(id, tags)`` replace the tags of their rows."""
    return entries.join(tags.select("id", F.col("tags").alias("__tags")), "id", "left").withColumn("tags", F.coalesce("__tags", "tags")).select(*entries.columns)


def deprecated(entries: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Soft delete of live rows, and one delete record for the change log for each."""
    rows = _hit(entries, ids)
    hit = F.col("__hit") & F.col("deleted_at").isNull()
    log = rows.where(hit).select(F.col("id").alias("entry_id"), F.lit("delete").alias("op_kind"), now.alias("created_at"))
    return rows.withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at"))).select(*entries.columns), log


def purged(entries: DataFrame, edges: DataFrame, embeddings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the ids of ``gone``: edges go with either end, embeddings with their row."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return entries.join(ids, "id", "left_anti"), left.select(*edges.columns), embeddings.join(ids, "id", "left_anti")


def evicted(entries: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """Candidates for eviction become tombstones."""
    rows = _hit(entries, candidates)
    return rows.withColumn("deleted_at", F.when(F.col("__hit"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).select(*entries.columns)


def pruned(log: DataFrame, now: Column, days: int, time: str = "created_at") -> DataFrame:
    """Log rows not older than the days."""
    return log.where(F.col(time) >= now - F.expr(f"interval {days} days"))


def edges_saved(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones put in; the same (from, to, type) keeps the new strength."""
    key = ["from_id", "to_id", "type"]
    every = edges.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in edges.columns if c not in key]
    return every.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("__new", *rest)).alias("x")).select(*key, "x.*").select(*edges.columns)


def vectors_saved(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """One vector an id, the new one where there is one."""
    return vectors.join(new.select("id"), "id", "left_anti").unionByName(new)


def neighbour_edges(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """(asked, from_id, to_id, type, strength) of the edges at each of ``ids``, from it, to it or both; two equi-joins."""
    asked = ids.select(F.col("id").alias("asked")).distinct()
    ends = {"from": ["from_id"], "to": ["to_id"], "both": ["from_id", "to_id"]}[direction]
    found = [edges.join(asked, edges[end] == F.col("asked")).select("asked", "from_id", "to_id", "type", "strength") for end in ends]
    return found[0] if len(found) == 1 else found[0].union(found[1]).distinct()


def proposed(batch: DataFrame, entries: DataFrame, now: Column, text_cols: tuple[str, ...] = ("title", "content")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch as it is written: (rows, edges, log).

    Private blocks go, then secrets, with a tag where one was found; content is cut to its bound; then the save rule
    of :func:`tessera.operators.entries.saved` decides. Rows carry action and supersedes; each superseded
    row gives a ``supersedes`` edge, each written row one record for the change log.
    """
    clean = batch
    for c in text_cols:
        clean = clean.withColumn(c, without_private(F.col(c)))
    before = F.xxhash64(*text_cols)
    clean = redacted_rows(clean.withColumn("__before", before), list(text_cols))
    secret = F.array(F.lit("redacted:secret"))
    tags = F.when(F.col("__before") != before, F.array_union(F.col("tags"), secret)).otherwise(F.col("tags"))
    clean = clean.withColumn("tags", tags).drop("__before").withColumn("content", bounded(F.col("content"), MOST_CHARS))
    rows = clean.join(saved(clean, entries, now), "id")
    edges = rows.where("supersedes is not null").select(F.col("id").alias("from_id"), F.col("supersedes").alias("to_id"), F.lit("supersedes").alias("type"), F.lit(1.0).alias("strength"))
    written = rows.where("action <> 'duplicate'")
    log = written.select(F.col("id").alias("entry_id"), F.when(F.col("action") == "created", "insert").otherwise("update").alias("op_kind"), now.alias("created_at"))
    return rows, edges, log


def rehashed(entries: DataFrame, n: int) -> DataFrame:
    """(id, content_hash) for the oldest ``n`` rows that lack a hash."""
    lacking = entries.where(F.col("content_hash").isNull()).orderBy("created_at", "id").limit(n)
    return lacking.select("id", content_hash(F.col("title"), F.col("content")).alias("content_hash"))


def scrubbed(entries: DataFrame) -> DataFrame:
    """(id, title, content, hits, heavy) of rows that hold secrets, cleaned; heavy where marks outweigh half of the text."""
    clean = redacted_rows(entries.select("id", "title", "content", F.octet_length("content").alias("__bytes")), ["title", "content"])
    marks = lambda c: F.coalesce(F.regexp_count(F.col(c), F.lit(r"\[REDACTED:")), F.lit(0))
    found = clean.withColumn("hits", marks("title") + marks("content")).where("hits > 0")
    return found.withColumn("heavy", (F.col("__bytes") > 0) & (marks("content") * 40 > F.col("__bytes"))).drop("__bytes")


# -- sessions --


def active_sessions(sessions: DataFrame, newest: int = 10) -> DataFrame:
    """Of each namespace's newest sessions, the first that is active."""
    recent = Window.partitionBy("namespace").orderBy(F.desc("started_at"), "id")
    some = sessions.withColumn("nth", F.row_number().over(recent)).where(F.col("nth") <= newest)
    return some.where("status = 'active'").groupBy("namespace").agg(F.min_by("id", "nth").alias("id"))


def sessions_updated(sessions: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Sessions with the update's non-null goal, summary and status; a session that ends gets the time."""
    fields = [c for c in ("goal", "summary", "status") if c in updates.columns]
    out = sessions.join(updates.select("id", *(F.col(c).alias(f"__{c}") for c in fields)), "id", "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    ended = F.col("status").isin("completed", "abandoned") & F.col("ended_at").isNull()
    return out.withColumn("ended_at", F.when(ended, now).otherwise(F.col("ended_at"))).select(*sessions.columns)


def expired(sessions: DataFrame, activity: DataFrame, now: Column, idle_minutes: int = 30, files: int = 5) -> DataFrame:
    """(id, minutes, summary) of active sessions idle for longer than the bound; ``activity(id, last_activity, files)``."""
    idle = sessions.where("status = 'active'").join(activity, "id", "left")
    minutes = F.floor((F.unix_seconds(now) - F.unix_seconds(F.coalesce("last_activity", "started_at"))) / 60)
    changed = F.coalesce(F.col("files"), F.array().cast("array<string>"))
    told = F.when(F.size(changed) == 0, "No file changes were tracked.").otherwise(
        F.concat(F.size(changed).cast("string"), F.lit(" file(s) modified: "), F.array_join(F.slice(changed, 1, files), ", "), F.lit("."))
    )
    said = F.concat(F.lit("Auto-expired after "), F.col("minutes").cast("string"), F.lit(" minutes of inactivity. "), told)
    return idle.withColumn("minutes", minutes).where(F.col("minutes") > idle_minutes).select("id", "minutes", said.alias("summary"))


def captured_prompts(prompts: DataFrame, prefix: int = 120) -> DataFrame:
    """``prompts(session, id, at, text)`` -> one row for each (session, prefix key): the newest prompt, and whether its session starts with it.

    Prompts that share their normalised first characters share a key, so a template with a varying tail supersedes itself.
    """
    key = F.substring(content_hash(F.lit(""), F.substring("text", 1, prefix)), 1, 16)
    keyed = prompts.withColumn("topic_key", key)
    goal = prompts.groupBy("session").agg(F.min_by("text", F.struct("at", "id")).alias("first"))
    newest = keyed.groupBy("session", "topic_key").agg(F.max_by(F.struct("id", "text"), F.struct("at", "id")).alias("x"), (F.count("*") - 1).alias("superseded"))
    return newest.join(goal, "session").select("session", "topic_key", F.col("x.id").alias("id"), "superseded", F.substring("first", 1, 120).alias("goal"))


def session_page(sessions: DataFrame) -> DataFrame:
    """(id, page): a session as markdown; sections without content are left out."""
    part = lambda head, c: F.when(F.length(F.coalesce(F.col(c), F.lit(""))) > 0, F.concat(F.lit(f"**{head}:** "), F.col(c)))
    title = F.concat(F.lit("## Session "), F.col("id").cast("string"), F.lit(" ("), F.col("status"), F.lit(")"))
    return sessions.select("id", F.concat_ws("\n", title, part("Goal", "goal"), part("Summary", "summary")).alias("page"))


def context_packet(entries: DataFrame, sessions: DataFrame, not_injected: tuple[str, ...], over: int = 128, most: int = 32, last: int = 3) -> DataFrame:
    """(namespace, kind, id, nth) of what a session starts with, for every namespace.

    Of the newest ``over`` live rows those of injectable kinds, ``most`` at most; and the last completed sessions
    among the newest ``2 * last``. Ranks are limits of a group, so a large namespace is cut before it is shuffled.
    """
    recent = Window.partitionBy("namespace").orderBy(F.desc("created_at"), "id")
    begun = Window.partitionBy("namespace").orderBy(F.desc("started_at"), "id")
    nth = Window.partitionBy("namespace").orderBy("nth")
    rows = live(entries).select("namespace", "id", "type", "created_at").withColumn("nth", F.row_number().over(recent)).where(F.col("nth") <= over)
    rows = rows.where(~F.col("type").isin(*not_injected)).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most)
    past = sessions.select("namespace", "id", "status", "started_at").withColumn("nth", F.row_number().over(begun)).where(F.col("nth") <= 2 * last)
    past = past.where("status = 'completed'").withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= last)
    return rows.select("namespace", F.lit("entry").alias("kind"), "id", "nth").union(past.select("namespace", F.lit("session"), "id", "nth"))


# -- queues --


def stale_claims_released(rows: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Claims older than the bound are released; confirmed rows keep theirs."""
    stale = F.col("confirmed_at").isNull() & (F.col("claimed_at") < now - F.expr(f"interval {seconds} seconds"))
    return rows.withColumn("claimed_at", F.when(stale, F.lit(None)).otherwise(F.col("claimed_at")))


def retained(rows: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Open rows, and confirmed ones not older than the days."""
    return rows.where(F.col("confirmed_at").isNull() | (F.col("confirmed_at") >= now - F.expr(f"interval {days} days")))


def pushed(rows: DataFrame, now: Column, claim_seconds: int = 900, most: int = 100) -> DataFrame:
    """One push: stale claims released, the oldest open rows claimed, coalesced to the latest of each entry.

    Gives (entry_id, id, ids): the row that is sent, and all ids that its success confirms.
    """
    ready = stale_claims_released(rows, now, claim_seconds).where("claimed_at is null and confirmed_at is null")
    claimed = ready.orderBy("created_at", "id").limit(most)
    best = F.struct("created_at", (-F.col("id")).alias("down"))
    return claimed.groupBy("entry_id").agg(F.max_by("id", best).alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))


def next_allowed(runs: DataFrame, factor: int = 20, least_ms: int = 30_000, most_ms: int = 600_000) -> DataFrame:
    """``runs(..., ended_ms, duration_ms, outcome)`` -> with ``not_before_ms``: some times the run's length, or a backoff by outcome."""
    gap = F.greatest(F.lit(least_ms), F.least(F.lit(most_ms), F.col("duration_ms") * factor))
    # fixed values: backoffs in milliseconds
    wait = F.when(F.col("outcome") == "settled", 3_600_000).when(F.col("outcome") == "blocked", 600_000).when(F.col("outcome") == "transient", 30_000).when(F.col("outcome") == "error", 300_000).otherwise(gap)
    return runs.withColumn("not_before_ms", F.col("ended_ms") + wait)


# -- change sets --


def merged_changes(listed: DataFrame, hashed: DataFrame, renamed: DataFrame) -> DataFrame:
    """(path, change) of two change sets and renames ``(source, target)``.

    A rename's target is not added, its source not deleted; of a path that is added and modified, added stays.
    """
    both = listed.union(hashed).distinct()
    sources, targets = (renamed.select(F.col(c).alias("path")).distinct() for c in ("source", "target"))
    added = both.where("change = 'added'").join(targets, "path", "left_anti")
    modified = both.where("change = 'modified'").join(added.select("path"), "path", "left_anti")
    deleted = both.where("change = 'deleted'").join(sources, "path", "left_anti")
    moved = renamed.select(F.col("target").alias("path"), F.lit("renamed").alias("change")).distinct()
    return added.union(modified).union(deleted).union(moved)


def retired(existing: DataFrame, written: DataFrame, plans: DataFrame) -> DataFrame:
    """Keys (plan, key) of the plans that were written again which the new version no longer has."""
    return existing.join(plans.select("plan").distinct(), "plan", "left_semi").join(written.select("plan", "key"), ["plan", "key"], "left_anti")


def supporting(primary: DataFrame, hits: DataFrame, most: int = 10) -> DataFrame:
    """``hits(question, id, term_no, rank)`` -> the first ``most`` distinct rows of a question that are not among its primary ones."""
    first = hits.join(primary.select("question", "id"), ["question", "id"], "left_anti").groupBy("question", "id").agg(F.min(F.struct("term_no", "rank")).alias("at"))
    w = Window.partitionBy("question").orderBy("at", "id")
    return first.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select("question", "id", "nth")


def crawl_state(previous: DataFrame, current: DataFrame, focus: str | None = None) -> DataFrame:
    """(path, hash) after a crawl: a focused one keeps what it did not see and its own hashes win, a whole one replaces all."""
    if focus is None:
        return current.select("path", "hash")
    return previous.join(current.select("path"), "path", "left_anti").select("path", "hash").union(current.where(in_subtree(F.col("path"), focus)).select("path", "hash"))


def in_subtree(path: Column, focus: str) -> Column:
    return (path == focus) | path.startswith(f"{focus.rstrip('/')}/")


def facts_replaced(facts: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("project", "file_path")) -> DataFrame:
    """Facts with those of every file in ``new`` replaced wholesale."""
    return facts.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*facts.columns).unionByName(new.select(*facts.columns))

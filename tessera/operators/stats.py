"""Counts and reports, each in grouped aggregates with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entries import live


def by_namespace(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """(namespace, entries, sessions): live rows and sessions joined in full."""
    a = live(entries).groupBy("namespace").agg(F.count("*").alias("entries"))
    b = sessions.groupBy("namespace").agg(F.count("*").alias("sessions"))
    return a.join(b, "namespace", "full_outer").select("namespace", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("entries", "sessions")))


def breakdown(entries: DataFrame) -> DataFrame:
    """(facet, value, entries) by type, layer and namespace of live rows, in one pass over them."""
    facets = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("type", "layer", "namespace")))
    return live(entries).select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("entries"))


def topics(entries: DataFrame, newest: int = 100, titles: int = 5) -> DataFrame:
    """Of the newest rows: count by type, with the newest titles of each."""
    recent = live(entries).orderBy(F.desc("created_at"), "id").limit(newest)
    made = F.sort_array(F.collect_list(F.struct((-F.unix_seconds("created_at")).alias("t"), "id", "title")))
    return recent.groupBy("type").agg(F.count("*").alias("entries"), F.array_join(F.transform(F.slice(made, 1, titles), lambda x: x["title"]), " | ").alias("titles"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Percentiles by nearest rank, ceil(n * p / 100), exact: ranks come from counts of distinct values.

    Values are first counted by (key, value), so a key with very many rows is combined before its ranks are taken.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    laid = counted.withColumn("upto", F.sum("c").over(upto))
    total = counted.groupBy(*keys).agg(F.sum("c").alias("n"))
    pick = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p / 100), F.col(value))).alias(f"p{p}")
    return laid.join(total, keys).groupBy(*keys).agg(*map(pick, percents))


def tool_usage(rows: DataFrame, batch: str, tool: str, file: str, most: int = 10) -> DataFrame:
    """Uses of each tool in a batch and the first distinct files in order."""
    uses = rows.groupBy(batch, tool).agg(F.count("*").alias("uses"))
    per = rows.select(batch, tool, file).distinct().withColumn("nth", F.row_number().over(Window.partitionBy(batch, tool).orderBy(file)))
    some = per.where(F.col("nth") <= most).groupBy(batch, tool).agg(F.array_join(F.sort_array(F.collect_list(file)), ",").alias("files"))
    return uses.join(some, [batch, tool])


def phase_progress(parts: DataFrame) -> DataFrame:
    """``parts(plan, phase, done)`` -> phases of each plan of which all parts are done, and all phases."""
    phases = parts.groupBy("plan", "phase").agg(F.every("done").alias("done"))
    return phases.groupBy("plan").agg(F.count_if("done").alias("done"), F.count("*").alias("total"))


def top_and_rest(counts: DataFrame, name: str, n: str, top: int) -> DataFrame:
    """The largest ``top`` rows and one row for all others."""
    best = counts.orderBy(F.desc(n), name).limit(top)
    rest = counts.join(best.select(name), name, "left_anti").agg(F.sum(n).alias(n)).where(F.col(n).isNotNull())
    return best.select(name, n).union(rest.select(F.lit("(other)"), n))


def coverage(files: DataFrame, top: int = 8) -> DataFrame:
    """(facet, value, n): files by status, the most frequent extensions of skipped ones, and sums of symbols, edges and unresolved calls."""
    status = files.groupBy(F.col("status").alias("value")).agg(F.count("*").alias("n")).select(F.lit("status").alias("facet"), "value", "n")
    ext = F.coalesce(F.nullif(F.regexp_extract("path", r"\.([^./]+)$", 1), F.lit("")), F.lit("(no extension)"))
    skipped = files.where("status = 'skipped_lang'").groupBy(ext.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)
    found = status.union(skipped.select(F.lit("skipped"), "value", "n"))
    sums = [c for c in ("symbol_count", "edge_count", "unresolved_calls") if c in files.columns]
    for c in sums:
        found = found.union(files.agg(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("n")).select(F.lit("sum"), F.lit(c), "n"))
    return found


def impl_groups(impls: DataFrame, least: int = 2) -> DataFrame:
    return impls.groupBy("trait").agg(F.countDistinct("file").alias("files")).where(F.col("files") >= least)


def result_tokens(page: DataFrame, text: Column) -> DataFrame:
    return page.agg(F.coalesce(F.sum(F.ceil(F.length(text) / 4)), F.lit(0)).cast("long").alias("tokens"), F.count("*").alias("rows"))


def project_listing(projects: DataFrame, **tables: DataFrame) -> DataFrame:
    """(project, n_<name>...) for every project: counts of each table, aggregated before the left joins."""
    out = projects.select("project").distinct()
    for name, df in tables.items():
        out = out.join(df.groupBy("project").agg(F.count("*").alias(f"n_{name}")), "project", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def work_rates(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``runs(..., outcome)`` -> runs, share of those that worked and of errors in whole percent (rounded down), by key."""
    n = F.count("*")
    share = lambda c: F.floor(F.count_if(c) * 100 / n).alias
    return runs.groupBy(*keys).agg(n.alias("runs"), share(F.col("outcome") == "done")("work_pct"), share(F.col("outcome") == "error")("error_pct"))


def skip_reasons(runs: DataFrame) -> DataFrame:
    """(reason, n) of skipped runs, most frequent first."""
    return runs.where("outcome = 'skipped'").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def hint_stats(log: DataFrame) -> DataFrame:
    """One row of ``log(session, kind, bytes)``: emissions, bytes, sessions, share of fires that emitted, bytes a session (whole numbers, null without any)."""
    emit = F.col("kind") == "emit"
    got = log.agg(
        F.count_if(emit).alias("emissions"), F.coalesce(F.sum(F.when(emit, F.col("bytes"))), F.lit(0)).cast("long").alias("total_bytes"),
        F.countDistinct(F.when(emit, F.col("session"))).alias("sessions"), F.count("*").alias("fires"),
    )
    whole = lambda a, b: F.when(F.col(b) > 0, F.floor(a / F.col(b)))
    return got.withColumn("hit_rate", whole(F.col("emissions") * 100, "fires")).withColumn("bytes_per_session", whole(F.col("total_bytes"), "sessions"))


def benchmark_summary(results: DataFrame) -> DataFrame:
    """``results(category, score, confidence, has_answer, ms)`` -> (category, questions, answered, score, confidence, ms), a row for each category and one (null) for all.

    Sums and counts by category are aggregated once; the row of all comes from them.
    """
    per = results.groupBy("category").agg(F.count("*").alias("questions"), F.count_if("has_answer").alias("answered"), *(F.sum(F.col(c).cast("double")).alias(c) for c in ("score", "confidence", "ms")))
    whole = per.agg(*(F.sum(c).alias(c) for c in ("questions", "answered", "score", "confidence", "ms"))).select(F.lit(None).cast("string").alias("category"), "*").where("questions > 0")
    mean = lambda c: (F.col(c) / F.col("questions")).alias(c)
    return per.union(whole).select("category", "questions", "answered", mean("score"), mean("confidence"), mean("ms"))


def scrub_report(scrubbed: DataFrame, hits: Column) -> DataFrame:
    """(kind, n) of the marks in rows that were cleaned, and the number of rows that are little else ("(heavy rows)")."""
    kinds = scrubbed.select(F.explode(hits).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.union(scrubbed.agg(F.count_if("heavy").alias("n")).select(F.lit("(heavy rows)"), "n"))


def noise_report(entries: DataFrame, noisy: Column) -> DataFrame:
    """(namespace, scanned, matched) of live prompts and bugs: those that would not be stored today."""
    rows = live(entries).where(F.col("type").isin("user-prompt", "bug"))
    return rows.groupBy("namespace").agg(F.count("*").alias("scanned"), F.count_if(noisy).alias("matched"))


def debt_by_file(markers: DataFrame) -> DataFrame:
    """``markers(path, line, marker)`` -> (path, n, kinds): markers of a file and their distinct kinds in order."""
    kinds = F.array_join(F.sort_array(F.collect_set("marker")), ",")  # seven kinds at most
    return markers.groupBy("path").agg(F.count("*").alias("n"), kinds.alias("kinds"))


def debt_groups(entries: DataFrame) -> DataFrame:
    """(place, type, n, oldest) of debt entries: by the first tag that looks like a file, else the key, else ``(unattributed)``."""
    file = F.get(F.filter("tags", lambda t: t.contains("/") | t.contains(".")), 0)
    place = F.coalesce(file, F.col("topic_key"), F.lit("(unattributed)"))
    return live(entries).groupBy(place.alias("place"), "type").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


def crawl_status(entries: DataFrame, newest: int = 1000) -> DataFrame:
    """(namespace, type, n, last_crawl) of each namespace's newest live rows; the time of its newest architecture summary or pattern."""
    recent = Window.partitionBy("namespace").orderBy(F.desc("created_at"), "id")
    rows = live(entries).select("namespace", "type", "title", "created_at", "id").withColumn("nth", F.row_number().over(recent)).where(F.col("nth") <= newest)
    told = (F.col("type") == "architecture") & F.col("title").rlike("^Architecture (summary|pattern)")
    return rows.groupBy("namespace", "type").agg(F.count("*").alias("n"), F.max(F.when(told, F.col("created_at"))).alias("last_crawl"))


def architecture_summary(files: DataFrame, stacks: tuple[tuple[str, str], ...], top: int = 5) -> DataFrame:
    """(facet, value, n) of ``files(path, lines, imports)``: files by depth, the largest extensions, and the stacks that imports name."""
    depth = F.size(F.split("path", "/")) - 1
    band = F.when(depth >= 4, "4+").otherwise(depth.cast("string"))
    ext = F.coalesce(F.nullif(F.regexp_extract("path", r"\.([^./]+)$", 1), F.lit("")), F.lit("(none)"))
    depths = files.groupBy(band.alias("value")).agg(F.count("*").alias("n")).select(F.lit("depth").alias("facet"), "value", "n")
    exts = files.groupBy(ext.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top).select(F.lit("extension"), "value", "n")
    low = F.array_join(F.transform("imports", lambda i: F.lower(i)), "\n")
    named = F.array_compact(F.array(*(F.when(low.contains(part), F.lit(name)) for name, part in stacks)))
    shown = files.select(F.explode(F.array_distinct(named)).alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit("stack"), "value", "n")
    return depths.union(exts).union(shown)


def transition_totals(transitions: DataFrame) -> DataFrame:
    """(next_layer, n) of rows that change layer."""
    return transitions.groupBy("next_layer").agg(F.count("*").alias("n"))


def recent_events(log: DataFrame, kind: str | None = None, entry: int | None = None, since: Column | None = None, limit: int = 20) -> DataFrame:
    """Newest rows of a log ``(id, entry_id, event, created_at)`` that fit what is given."""
    rows = log.where(F.col("event") == kind) if kind else log
    rows = rows.where(F.col("entry_id") == entry) if entry is not None else rows
    rows = rows.where(F.col("created_at") >= since) if since is not None else rows
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)

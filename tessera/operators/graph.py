"""Symbol and file graphs: neighbours, fan counts, bounded walks, importance, call resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import name_tokens
from tessera.sources.shared import written

from .search import bm25
from .stats import top_and_rest


def fan_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(id)``, ``edges(source, target)`` -> call sites and distinct callers and callees of every node."""
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("sites_in"), F.countDistinct("source").alias("callers"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("sites_out"), F.countDistinct("target").alias("callees"))
    counts = ["sites_in", "callers", "sites_out", "callees"]
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))


def walk(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """Breadth-first depths (id, depth) of what the seeds reach in at most ``max_depth`` steps.

    One join and one anti-join a step; the frontier is distinct, so a hub is entered once. Every step's frontier is
    written, so no step is computed twice and plans do not grow.
    """
    links = written(edges.select(F.col("source").alias("from"), F.col("target").alias("id")).distinct())
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, max_depth + 1):
        found = front.select(F.col("id").alias("from")).join(links, "from").select("id").distinct()
        front = written(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(front)
    return seen


def trace(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, limit: int = 200) -> DataFrame:
    """(id, depth, truncated) of the nearest ``limit`` nodes around one or more seeds, the seeds left out.

    ``truncated`` where the limit cut the list or the depth bound left a frontier. A step beyond the limit is not walked.
    """
    links = written(edges.select(F.col("source").alias("from"), F.col("target").alias("id")).distinct())
    start = seeds.select("id").distinct()
    seen, front, n, cut = start.withColumn("depth", F.lit(0)), start, 0, False
    for depth in range(1, max_depth + 1):
        found = front.select(F.col("id").alias("from")).join(links, "from").select("id").distinct()
        front = written(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        more = front.count()
        n, seen, cut = n + more, seen.union(front), more > 0
        if n >= limit or not more:
            break
    return seen.where("depth > 0").orderBy("depth", "id").limit(limit).withColumn("truncated", F.lit(cut))


def neighbours(edges: DataFrame, symbols: DataFrame, asked: DataFrame, direction: str = "callees") -> DataFrame:
    """(asked, id, qualified_name, line) one hop away from each of ``asked(id)`` over calls, in the order of lines."""
    own, other = ("source", "target") if direction == "callees" else ("target", "source")
    calls = edges.where("type = 'CALLS'") if "type" in edges.columns else edges
    hop = calls.join(asked.select(F.col("id").alias("asked")).distinct(), F.col(own) == F.col("asked"))
    return hop.select("asked", F.col(other).alias("id"), "line").join(symbols.select("id", "qualified_name"), "id").select("asked", "id", "qualified_name", "line").orderBy("asked", "line", "qualified_name")


def all_edges(edges: DataFrame) -> DataFrame:
    """Every edge of every type, in the order of its ends, type and line."""
    return edges.orderBy("source", "target", "type", "line")


#: fixed values: what a kind of symbol adds to its score in a search
LABEL_BOOST = (("Function", 10.0), ("Method", 10.0), ("Class", 5.0), ("Trait", 5.0), ("Struct", 5.0), ("Interface", 5.0), ("Enum", 5.0))


def symbol_search(symbols: DataFrame, terms: DataFrame, limit: int, label: str | None = None) -> DataFrame:
    """(question, id, qualified_name, score) of the best symbols by BM25 over the words of their names, plus their label's boost."""
    rows = symbols.where(F.col("label") == label) if label else symbols
    found = bm25(symbols, terms, text=name_tokens(F.col("name"))).join(rows.select("id", "label", "qualified_name"), "id")
    boost = reduce(lambda c, x: c.when(F.col("label") == x[0], x[1]), LABEL_BOOST, F).otherwise(0.0)
    w = Window.partitionBy("question").orderBy(F.desc("score"), "qualified_name", "id")
    return found.withColumn("score", F.col("score") + boost).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).select("question", "id", "qualified_name", "score")


def ranked_symbols(symbols: DataFrame, by: str, top: int = 14) -> DataFrame:
    """The symbols with the most of ``by`` (complexity, call sites); ties by name."""
    return symbols.where(F.col(by) > 0).orderBy(F.desc(by), "name", "id").limit(top)


def related_types(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """``relations(relation_id, file_path, subject, object, kind)`` -> (relation_id, source, target, kind) where both names stand for one symbol.

    A name of the same file comes first, then one that is the only one at all; modules are no types, and nothing relates to itself.
    """
    types = symbols.where("label <> 'Module'").select(F.col("id").alias("target"), F.col("name").alias("callee"), "file_path")
    ends = relations.select("relation_id", "file_path", "kind", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("subject").alias("callee")), F.struct(F.lit(1).alias("end"), F.col("object").alias("callee")))).alias("e"))
    ends = ends.select("relation_id", "file_path", "kind", "e.end", "e.callee")
    one = lambda rows, tier: rows.groupBy("relation_id", "kind", "end").agg(F.min("target").alias("target"), F.max("target").alias("most")).where("target = most").withColumn("tier", F.lit(tier))
    every = one(ends.join(types, ["callee", "file_path"]), 1).union(one(ends.join(unique_names(types), "callee"), 2))
    best = every.groupBy("relation_id", "kind", "end").agg(F.min_by("target", "tier").alias("target"))
    both = best.groupBy("relation_id", "kind").agg(F.max(F.when(F.col("end") == 0, F.col("target"))).alias("source"), F.max(F.when(F.col("end") == 1, F.col("target"))).alias("target"))
    return both.where("source <> target").select("relation_id", "source", "target", "kind")


def qualified_calls(calls: DataFrame, imports: DataFrame, symbols: DataFrame, common: tuple[str, ...] = ()) -> DataFrame:
    """``calls(call_id, file_path, container, qualifier, callee)`` -> (call_id, target, resolution, confidence).

    Tiers in order: a member of the caller's own container (``self``, ``Self``, ``this``); a symbol of the file that an
    import of the qualifier names; the member of the only container of the qualifier's name; the only member of that
    name at all, unless the name is a ``common`` one. Each tier is an equi-join that keeps calls with one candidate.
    """
    s = symbols.select(F.col("id").alias("target"), F.col("name").alias("callee"), "container", F.col("file_path").alias("symbol_file"))
    own = calls.where(F.col("qualifier").isin("self", "Self", "this"))
    path = calls.where(~F.col("qualifier").isin("self", "Self", "this"))

    def only(found: DataFrame, tier: int, name: str, confidence: float) -> DataFrame:
        one = found.groupBy("call_id").agg(F.min("target").alias("target"), F.max("target").alias("most")).where("target = most")
        return one.select("call_id", "target", F.lit(tier).alias("tier"), F.lit(name).alias("resolution"), F.lit(confidence).alias("confidence"))

    named = imports.select("file_path", F.col("local_name").alias("qualifier"), F.col("source").alias("symbol_file"))
    members = s.where("container is not null").groupBy("container", "callee").agg(F.min("target").alias("target"), F.max("target").alias("most")).where("target = most").drop("most")
    loose = unique_names(s.where("container is not null"))
    tiers = [
        only(own.join(s.withColumnRenamed("symbol_file", "file_path"), ["file_path", "container", "callee"]), 1, "same_module", 0.90),
        only(path.drop("container").join(named, ["file_path", "qualifier"]).join(s, ["callee", "symbol_file"]), 2, "import_map", 0.95),
        only(path.drop("container").join(members.withColumnRenamed("container", "qualifier"), ["qualifier", "callee"]), 3, "unique_name", 0.75),
        only(path.where(~F.col("callee").isin(*common)).join(loose, "callee"), 4, "suffix", 0.55),
    ]
    every = reduce(DataFrame.union, tiers)
    return every.groupBy("call_id").agg(F.min_by(F.struct("target", "resolution", "confidence"), "tier").alias("x")).select("call_id", "x.*")


def unresolved_by_file(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """(file_path, unresolved) calls without a target; files without any are left out."""
    return calls.join(resolved.select("call_id"), "call_id", "left_anti").groupBy("file_path").agg(F.count("*").alias("unresolved"))


def view_payload(nodes: DataFrame, edges: DataFrame, files: DataFrame, top: int = 22) -> DataFrame:
    """(part, key, n) of what a view shows: totals, the largest modules with the rest folded, and nodes by label."""
    totals = [df.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit(name).alias("key"), "n") for name, df in (("nodes", nodes), ("edges", edges), ("files", files))]
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    modules = top_and_rest(files.groupBy(folder.alias("key")).agg(F.count("*").alias("n")), "key", "n", top).select(F.lit("module").alias("part"), "key", "n")
    labels = nodes.groupBy(F.col("label").alias("key")).agg(F.count("*").alias("n")).select(F.lit("label").alias("part"), "key", "n")
    return reduce(DataFrame.union, [*totals, modules, labels])


def truncated(edges: DataFrame, reached: DataFrame, max_depth: int) -> DataFrame:
    """One row: whether nodes beyond ``max_depth`` remain."""
    front = reached.where(F.col("depth") == max_depth).select(F.col("id").alias("source"))
    beyond = edges.join(front, "source", "left_semi").select(F.col("target").alias("id")).join(reached, "id", "left_anti")
    return beyond.agg((F.count("*") > 0).alias("truncated"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    return edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("sites")).orderBy(F.desc("sites"), "id").limit(k)


#: symbols up to which their names, with the ids of each, go to the tasks as one table; more are met by a shuffle
MOST_BROADCAST = 1 << 21


def edges_of(calls: DataFrame, symbols: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Names at both ends to ids; what does not resolve goes, repeated edges once.

    Edges are made distinct by name, before each end stands for all ids of its name; the lists of ids are opened last, so no edge by id is shuffled. Two
    names lead to the same edge only where an id has several names; edges with such an end are made distinct by id.
    """
    named = symbols.select("id", "qualified_name").where("qualified_name is not null").distinct()
    several = F.count("*").over(Window.partitionBy("id")) > 1
    ids = lambda which: F.collect_list(F.when(which, F.struct("id")))["id"]  # noqa: E731  a struct, so that a null id stays
    lists = written(named.withColumn("several", several).groupBy("qualified_name").agg(ids(~F.col("several")).alias("one"), ids(F.col("several")).alias("more")))
    held = lists.agg(F.sum(F.size("one")).alias("one"), F.sum(F.size("more")).alias("more")).first()
    sent = F.broadcast if (held.one or 0) + (held.more or 0) <= most_broadcast else lambda x: x
    once = calls.select("source_name", "target_name", "type", "line").where("source_name is not null and target_name is not null").distinct()

    def opened(source: Column, target: Column) -> DataFrame:
        a = lists.select(F.col("qualified_name").alias("source_name"), source.alias("sources")).where("size(sources) > 0")
        b = lists.select(F.col("qualified_name").alias("target_name"), target.alias("targets")).where("size(targets) > 0")
        rows = once.join(sent(a), "source_name").join(sent(b), "target_name").select(F.explode("sources").alias("source"), "targets", "type", "line")
        return rows.select("source", F.explode("targets").alias("target"), "type", "line")

    one, more = F.col("one"), F.col("more")
    certain = opened(one, one)
    return certain.union(opened(more, F.concat(one, more)).union(opened(one, more)).distinct()) if held.more else certain


def symbol_lookup(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """``names(asked)`` -> (asked, id, tier, total): exact qualified name, else name, else suffix after ``:`` or ``.``.

    Suffixes are exploded and joined, so every tier is an equi-join.
    """
    parts = F.split("qualified_name", "[:.]")
    n = F.size(parts)
    # tails of the qualified name at each separator, with the separators as they are
    tails = F.transform(
        F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.col("qualified_name").substr(F.length(F.array_join(F.slice(parts, 1, k), ".")) + 2, F.length("qualified_name")),
    )
    keys = F.array_union(
        F.array(F.struct(F.lit(1).alias("tier"), F.col("qualified_name").alias("key")), F.struct(F.lit(2).alias("tier"), F.col("name").alias("key"))),
        F.transform(tails, lambda t: F.struct(F.lit(3).alias("tier"), t.alias("key"))),
    )
    listed = symbols.select("id", F.explode(keys).alias("k")).select("id", "k.tier", F.col("k.key").alias("asked"))
    found = listed.join(names.select("asked").distinct(), "asked", "left_semi").groupBy("asked", "id").agg(F.min("tier").alias("tier"))
    best = found.groupBy("asked").agg(F.min("tier").alias("tier"))
    hit = found.join(best, ["asked", "tier"])
    return hit.join(hit.groupBy("asked").agg(F.count("*").alias("total")), "asked").select("asked", "id", "tier", "total")


def resolved_calls(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Unqualified calls (call_id, file_path, callee) to (call_id, target, resolution, confidence).

    Tiers in order: the symbol an import names, the only one of that name in the file, the only one of that name at all.
    Each tier is an equi-join that keeps calls with exactly one candidate.
    """
    s = symbols.select(F.col("id").alias("target"), F.col("name").alias("callee"), F.col("file_path").alias("symbol_file"))

    def only(found: DataFrame, tier: int, name: str, confidence: float) -> DataFrame:
        one = found.groupBy("call_id").agg(F.min("target").alias("target"), F.max("target").alias("most")).where("target = most")
        return one.select("call_id", "target", F.lit(tier).alias("tier"), F.lit(name).alias("resolution"), F.lit(confidence).alias("confidence"))

    named = imports.select("file_path", F.col("local_name").alias("callee"), F.col("source").alias("symbol_file"))
    tiers = [
        only(calls.join(named, ["file_path", "callee"]).join(s, ["callee", "symbol_file"]), 1, "import_map", 0.95),
        only(calls.join(s.withColumnRenamed("symbol_file", "file_path"), ["callee", "file_path"]), 2, "same_module", 0.90),
        only(calls.join(unique_names(s), "callee"), 3, "unique_name", 0.75),
    ]
    every = tiers[0].union(tiers[1]).union(tiers[2])
    return every.groupBy("call_id").agg(F.min_by(F.struct("target", "resolution", "confidence"), "tier").alias("x")).select("call_id", "x.*")


def unique_names(symbols: DataFrame) -> DataFrame:
    """Names that stand for one symbol: folded before any join, so a common name never multiplies its calls."""
    return symbols.groupBy("callee").agg(F.min("target").alias("target"), F.max("target").alias("most")).where("target = most").drop("most")


# fixed values: what a file's path says of its worth, first match wins
FILE_KINDS = (
    (r"(^|/)claude\.md$", 40), (r"(^|/)(readme|agents)\.md$", 30), (r"/phases/.*\.md$", 25), (r"\.mdx?$", 15),
    (r"(^|/)docker-compose[^/]*\.ya?ml$", 18), (r"(^|/)dockerfile$", 16), (r"(^|/)makefile$", 14), (r"(^|/)\.env\.example$", 14),
    (r"migration.*\.(sql|xml|json|rb|py|java|cs)$", 28), (r"\.sql$", 28),
    (r"(^|/)(main|app|server|bootstrap|startup)\.[^./]+$", 25), (r"(^|/)(program|application)\.[^./]+$", 22),
    (r"\.(spec|test)\.", 5), (r"__(tests?|specs?)__", 3), (r"^(?!.*/util).*/tests?/", 3),
    (r"\.module\.ts$", 22), (r"\.service\.ts$", 18), (r"\.controller\.ts$", 18), (r"\.entity\.ts$", 22), (r"\.guard\.ts$", 16),
    (r"\.middleware\.ts$", 16), (r"\.decorator\.ts$", 14), (r"/migrations?/.*\.([tj]sx?|mjs|cjs)$", 25), (r"\.dto\.ts$", 12), (r"\.config\.ts$", 12),
    (r"\.(schema|model)\.ts$", 20), (r"\.repository\.ts$", 16), (r"\.factory\.ts$", 10), (r"/(storage|adapters?)/.*\.([tj]sx?|mjs|cjs)$", 20), (r"/mcp/.*\.([tj]sx?|mjs|cjs)$", 20),
    (r"/(crawl|graph|analysis|scoring)/.*\.([tj]sx?|mjs|cjs)$", 18), (r"/(scanner|discovery|bridge)/.*\.([tj]sx?|mjs|cjs)$", 16), (r"(interface|adapter|bridge)[^/]*\.([tj]sx?|mjs|cjs)$", 18),
    (r"/(pages|app)/.*\.[tj]sx$", 18), (r"/components/.*\.([tj]sx?|mjs|cjs)$", 10), (r"/hooks/.*\.([tj]sx?|mjs|cjs)$", 12), (r"/context/.*\.([tj]sx?|mjs|cjs)$", 14), (r"/store/.*\.([tj]sx?|mjs|cjs)$", 14),
    (r"/packages/.*/src/index\.ts$", 14), (r"(^|/)index\.[tj]sx?$", -8), (r"/constants?/.*\.([tj]sx?|mjs|cjs)$", 6), (r"/utils?/.*\.([tj]sx?|mjs|cjs)$", 6), (r"/types?/.*\.([tj]sx?|mjs|cjs)$", 8), (r"\.([tj]sx?|mjs|cjs)$", 5),
    (r"tsconfig\.base\.json$", 20), (r"(^|/)tsconfig[^/]*\.json$", 15), (r"^(?!.*node_modules)(.*/)?package\.json$", 18),
    (r"(^|/)__init__\.py$", -5), (r"(^|/)(models?|schema)\.py$", 22), (r"(^|/)(views?|routes?|api)\.py$", 18), (r"(^|/)(middleware|decorators?)\.py$", 16),
    (r"(^|/)(settings?|config)\.py$", 18), (r"(^|/)(serializers?|validators?|tasks?|celery)\.py$", 14), (r"(^|/)(manage|wsgi|asgi)\.py$", 20), (r"\.py$", 5),
    (r"_test\.go$", 3), (r"handler[^/]*\.go$", 18), (r"router[^/]*\.go$", 20), (r"service[^/]*\.go$", 18), (r"(repository|store)[^/]*\.go$", 20),
    (r"middleware[^/]*\.go$", 16), (r"\.go$", 5),
    (r"(^|/)lib\.rs$", 22), (r"(^|/)mod\.rs$", 15), (r"handler[^/]*\.rs$", 18), (r"router[^/]*\.rs$", 20), (r"\.rs$", 5), (r"\.ya?ml$", 10),
)
OTHER_KIND = 3


def file_kind(path: Column) -> Column:
    """Points for the kind of a file, by its path in lower case."""
    low = F.lower(path)
    return reduce(lambda c, x: c.when(low.rlike(x[0]), x[1]), FILE_KINDS, F).otherwise(OTHER_KIND)


def importance(files: DataFrame, imports: DataFrame, depths: DataFrame, now) -> DataFrame:
    """(path, score, band): closeness to an entry point, importers, kind of file, size and age."""
    fan = imports.groupBy(F.col("target").alias("path")).agg(F.countDistinct("source").alias("importers"))
    far = depths.agg((F.coalesce(F.max("depth"), F.lit(-1)) + 1).alias("far"))
    d, n = F.coalesce("depth", "far"), F.coalesce("importers", F.lit(0))
    near = F.greatest(F.lit(0), 30 - 5 * d)
    used = F.when(n >= 10, 25).when(n >= 5, 20).when(n >= 3, 15).when(n >= 1, 10).otherwise(0)
    lines = F.col("lines")
    size = F.when(lines > 500, 10).when(lines > 200, 7).when(lines > 50, 4).when(lines < 20, -5).otherwise(0)
    age = F.floor((F.unix_seconds(now) - F.unix_seconds("modified")) / 86400)
    fresh = F.when(F.col("modified").isNull(), 0).when(age < 7, 10).when(age < 30, 7).when(age < 90, 4).when(age < 180, 2).otherwise(0)
    kind = file_kind(F.col("path").cast("string"))
    score = F.least(F.lit(100), F.greatest(F.lit(0), near + used + kind + size + fresh)).cast("int")
    band = F.when(F.col("score") >= 65, "deep").when(F.col("score") >= 40, "medium").when(F.col("score") >= 20, "light").otherwise("skip")
    rows = files.join(fan, "path", "left").join(depths.withColumnRenamed("id", "path"), "path", "left").crossJoin(F.broadcast(far))  # one row
    return rows.select("path", score.alias("score")).withColumn("band", band)

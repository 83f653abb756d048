"""Mixing sources to target weights with a low-discrepancy source schedule, in DataFrame functions only.

Targets: every source asks for its weight's share of all words, no source for more than
``most`` times its own words; what that leaves over is shared again by weight. With the
sources in order of ratio (cap : weight) this is one running sum, no iteration.

Schedule: slot ``j`` has the golden-ratio point ``j * G mod 2^62`` (G the odd number next to 2^62 / 1.618...), mapped
through the cumulative slot counts to a source; the slots of a source are ranked, and rank ``k`` takes block
``k mod blocks`` of that source's shuffled words, blocks being of ``block_words`` words. Where the points give a
source a few slots too many they are left out; too few are made up at the end of the
schedule, and a source's last slot ends at its target. Ranks and running sums are taken in two levels (parts of a
range-dealt order, buckets of slots or of hash ranges), so neither a source with a third of all rows nor a great
number of sources meets in one task. The driver reads totals only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
#: the odd number next to 2^62 divided by the golden ratio: points repeat after 2^62 slots only
GOLDEN = (isqrt(5 << 124) - (1 << 62)) >> 1 | 1
BLOCK_WORDS, CELLS = 1024, 4096
_HALF = (1 << 31) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], *sums: str) -> DataFrame:
    """``rows`` with their number ``nth`` in the order, from 0, and ``<name>_before`` for each of the sums.

    Range-dealt parts are numbered within; what comes before a part is a sum over the parts' totals, one row for each.
    """
    parts = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    per = parts.groupBy("part").agg(F.count("*").alias("rows"), *(F.sum(c).alias(f"all_{c}") for c in sums))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"base_{c}") for c in ("rows", *(f"all_{c}" for c in sums))))
    within = Window.partitionBy("part").orderBy(*order)
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    laid = parts.withColumn("nth", F.row_number().over(within) - 1)
    for c in sums:
        laid = laid.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(ahead), F.lit(0)))
    found = laid.join(base, "part").withColumn("nth", F.col("nth") + F.col("base_rows"))
    for c in sums:
        found = found.withColumn(f"{c}_before", F.col(f"{c}_before") + F.col(f"base_all_{c}"))
    return found.select(*rows.columns, "nth", *(f"{c}_before" for c in sums))


def _by_source() -> list[Column]:
    return [F.col("source").isNull(), F.col("source")]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` -> with weight, target and words (the target in whole words).

    Sources are numbered by code point, null last.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("nth", F.lit(len(weights))).cast("int") + 1).cast("long")
    known = running(sizes.select("source", "source_size"), _by_source()).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    ratio = [F.col("cap") / F.col("weight"), *_by_source()]
    ranked = materialize(running(known.drop("nth"), ratio, "cap", "weight"))
    all_words, all_weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    level = (F.lit(all_words) - F.col("cap_before")) / (F.lit(all_weight) - F.col("weight_before"))
    cap = F.col("cap").cast("double")
    share = ranked.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.max("level")).first()[0]
    target = F.round(cap if share is None else F.least(cap, F.lit(share) * F.col("weight")), 6)
    return (
        ranked.withColumn("target", target)
        .withColumn("words", F.least(F.col("cap"), F.floor(F.col("target") + 0.5)))
        .select("source", "source_size", "weight", "target", "words")
    )


def shuffled_words(docs: DataFrame) -> DataFrame:
    """``docs(id, source, size, ...)`` -> with ``first``, the word number at which the document starts
    when its source's documents lie end to end in the order of a hash of their ids."""
    hashed = docs.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("h", 1, 3))
    per = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("source", "bucket", F.coalesce(F.sum("bucket_words").over(earlier), F.lit(0)).alias("base"))
    rest = [c for c in docs.columns if c not in ("id", "source", "size")]
    within = Window.partitionBy("source", "bucket").orderBy("h", "id", "size", *rest).rowsBetween(Window.unboundedPreceding, -1)
    joined = hashed.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        base.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")),
    )
    return joined.select(*docs.columns, (F.col("base") + F.col("ahead")).alias("first"))


def point(slot: Column) -> Column:
    """The slot's golden-ratio point in [0, 2^62), by halves of 31 bits, so that no product overflows."""
    hi, lo = F.shiftright(slot, 31).bitwiseAND(F.lit(_HALF)), slot.bitwiseAND(F.lit(_HALF))
    cross = (hi * F.lit(GOLDEN & _HALF) + lo * F.lit(GOLDEN >> 31)).bitwiseAND(F.lit(_HALF))
    return (F.shiftleft(cross, 31) + lo * F.lit(GOLDEN & _HALF)).bitwiseAND(F.lit((1 << 62) - 1))


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots ``(source, slot, rank, block, n_words)``: which block of which source comes when.

    ``plan`` is what :func:`targets` returns. ``slot`` orders the mix; closing slots come last.
    """
    spark = plan.sparkSession
    width = block_words
    per_epoch = F.ceil(F.col("source_size") / width).cast("long")
    rest = F.expr("words % source_size")
    needs = plan.where("words > 0").select(
        "source", "source_size", "words", per_epoch.alias("blocks"),
        (F.expr("words div source_size") * per_epoch + F.ceil(rest / width)).cast("long").alias("slots"),
    )
    total, sources = needs.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    parts = needs.withColumn("part_size", F.floor(F.col("slots") / F.lit(max(1, total)) * F.lit(2.0**31)).cast("long"))
    share = materialize(running(parts, _by_source(), "part_size").withColumn("lo", F.col("part_size_before")).withColumn("hi", F.expr("lo + part_size")))
    span = share.agg(F.max("hi")).first()[0] or 1
    at = F.shiftright(F.shiftright(point(F.col("slot")), 31) * F.lit(span), 31)
    step = -(-span // max(CELLS, 4 * sources))
    reach = share.where("part_size > 0").withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {step}"), F.expr(f"(hi - 1) div {step}"))))
    dealt = (
        spark.range(total).withColumnRenamed("id", "slot")
        .withColumn("at", at)
        .withColumn("cell", F.expr(f"at div {step}"))
        .join(reach, "cell")
        .where("at >= lo and at < hi")
        .select("source", "slot", F.shiftright("slot", 14).alias("bucket"))
    )
    per = dealt.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("slot")
    ranked = (
        dealt.withColumn("nth", F.row_number().over(within) - 1)
        .join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .select("source", "slot", (F.col("base") + F.col("nth")).alias("rank"))
    )
    given = per.groupBy("source").agg(F.sum("n").alias("given")).withColumnRenamed("source", "s")
    short = (
        share.join(given, F.col("source").eqNullSafe(F.col("s")), "left")
        .where("slots > coalesce(given, 0)")
        .select("source", "lo", F.explode(F.sequence(F.coalesce("given", F.lit(0)).cast("long"), F.col("slots") - 1)).alias("rank"))
        .select("source", (F.lit(total) + F.col("lo") + F.col("rank")).alias("slot"), "rank")
    )
    facts = share.select(F.col("source").alias("s"), "source_size", "words", "blocks", "slots")
    epoch, block = F.expr("rank div blocks"), F.expr("rank % blocks")
    start = epoch * F.col("source_size") + block * width
    size = F.least(F.lit(width), F.col("source_size") - block * width, F.col("words") - start)
    return (
        ranked.union(short)
        .join(facts, F.col("source").eqNullSafe(F.col("s")))
        .where("rank < slots")
        .select("source", "slot", "rank", block.alias("block"), size.alias("n_words"))
    )


def _planned(rows: DataFrame, weights: tuple[int, ...], most: int, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(id, source, size, ...)`` -> the sources' plan, the slots, and the rows with their first word's number."""
    plan = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    return plan, schedule(plan, block_words), shuffled_words(rows)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken.

    ``taken`` counts the words of the document in the mix, repeats included; a source's sum is its
    target in whole words, a document's at most ``most`` times its size. Null or blank text
    has size zero and takes nothing; a null source is a source of its own. Repeated rows are
    documents of their own. Other columns are ignored. An empty table gives an empty table.
    ``block_words`` is the grain of the schedule, the same at every size of the corpus.
    """
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    )
    plan, slots, laid = _planned(rows, weights, most, block_words)
    width = block_words
    # how often each word of a block is taken: whole slots, and the first words by those cut short
    use = slots.groupBy("source", "block").agg(F.sort_array(F.collect_list("n_words")).alias("used"))
    pieces = laid.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + size - 1) div {width}")))
    )
    # words of the piece inside its block: [a, b)
    a = F.greatest(F.col("first") - F.col("block") * width, F.lit(0))
    b = F.least(F.col("first") + F.col("size") - F.col("block") * width, F.lit(width))
    hit = F.aggregate("used", F.lit(0).cast("long"), lambda s, u: s + F.greatest(F.least(u, F.col("b")) - F.col("a"), F.lit(0)))
    u = use.select(F.col("source").alias("s"), F.col("block").alias("k"), "used")
    taken = (
        pieces.withColumn("a", a).withColumn("b", b)
        .join(u, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
        .select("id", "source", "first", hit.alias("taken"))
        .groupBy("id", "source", "first").agg(F.sum("taken").alias("taken"))
    )
    t = taken.select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("first").alias("f"), "taken")
    facts = plan.select(F.col("source").alias("p"), "source_size", "target")
    return (
        laid.join(t, F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("first") == F.col("f")) & (F.col("size") > 0), "left")
        .join(facts, F.col("source").eqNullSafe(F.col("p")))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns kept, dealt in the order of the schedule.

    A copy stands where the slot of its first word's block does. Documents are taken whole: the one that a source's
    target cuts is taken if at least half of it lies before the cut, so a source is off by half of one document
    at most. A document of no words is in no mix and goes; a null source is a source of its own; rows are
    told apart by their place in a written copy of ``docs``, so repeated ids and rows are documents of their own.
    An empty table gives an empty table.
    """
    texts = materialize(docs.withColumn("__u", F.monotonically_increasing_id()), "zstd")
    rows = materialize(
        texts.select(F.col("__u").alias("u"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    )
    plan, slots, laid = _planned(rows, weights, most, block_words)
    facts = plan.select(F.col("source").alias("p"), "source_size", "words", F.ceil(F.col("source_size") / block_words).cast("long").alias("blocks"))
    more = (F.least(F.expr("words % source_size"), F.expr("first + size")) - F.col("first")) * 2 >= F.col("size")
    n = (F.expr("words div source_size") + F.when(more, 1).otherwise(0)).cast("int")
    copies = (
        laid.where("size > 0").join(facts, F.col("source").eqNullSafe(F.col("p")))
        .withColumn("n", n).where("n > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("u", "source", "first", (F.col("epoch") * F.col("blocks") + F.expr(f"first div {block_words}")).alias("place"))
    )
    order = slots.select(F.col("source").alias("s"), F.col("rank"), "slot")
    placed = copies.join(order, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("rank"))).select(F.col("u").alias("__u"), F.col("slot").alias("__slot"), F.col("first").alias("__first"))
    place = ["__slot", "__first"]
    return texts.join(placed, "__u").repartitionByRange(*place).sortWithinPartitions(*place).select(*docs.columns)

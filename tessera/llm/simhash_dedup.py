"""SimHash near-dedup with pigeonhole blocks.

Fingerprints are the bitwise majority of the XXH64 hashes of a text's word shingles. Two
fingerprints at most ``max_distance`` bits apart differ in at most that many of
``max_distance + 2`` blocks, so they agree on two blocks at least: every fingerprint is
listed under each pair of its blocks, lists are joined on the block values, and members of
a list are verified by their Hamming distance.

Copies fold into one node for each distinct fingerprint first. A list with more than
``tile`` members is dealt out by pairs of tiles, so that no task holds more than two tiles;
what leaves a task is a spanning set of verified links, not all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .rows import row_key, text_hash, without
from .storage import materialize

SEED = 42
_LANES = np.arange(8) * 256
#: the eight bits of each byte value, lowest first
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned SimHash of one text; zero if it has no words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    return majority(np.array(hashes, np.dtype("<u8")))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    n = len(hashes)
    lanes = hashes.view(np.uint8).reshape(n, 8) + _LANES
    seen = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS).ravel()
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["id", "h", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id, h, fp)`` for every row; h is a hash of the text, fp holds the 64 bits as a signed long."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), text_hash(text).alias("h"))
    return rows.mapInArrow(_fingerprints(width), "id long, h long, fp long")


def _blocks(max_distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks that split 64 bits as evenly as possible."""
    n = max_distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _spanning_links(fps: np.ndarray, ids: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links that join what is within reach in one list, found breadth first."""
    links, todo = [], np.arange(len(fps))
    while len(todo):
        root, front, todo = todo[0], todo[:1], todo[1:]
        while len(front) and len(todo):
            near = np.zeros(len(todo), bool)
            for part in np.array_split(front, -(-len(front) // 256)):
                near |= (np.bitwise_count(fps[todo][:, None] ^ fps[part][None, :]) <= max_distance).any(1)
            front, todo = todo[near], todo[~near]
            links += [(int(ids[root]), int(ids[x])) for x in front]
    return links


def _verify(max_distance: int, small: int = 24):
    """Lists arrive sorted by (list, tile pair); small ones are compared many at a time."""

    def one(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = np.ascontiguousarray(ids)
        fps = ids.view(np.uint64)
        turn = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        starts = np.concatenate([[0], turn])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        group = np.repeat(np.arange(len(starts)), sizes)
        a, b = [], []
        little = np.repeat(sizes <= small, sizes)
        g, f, i = group[little], fps[little], ids[little]
        for step in range(1, small):
            if step >= len(g):
                break
            same = np.flatnonzero(g[step:] == g[:-step])
            if not len(same):
                break
            hit = same[np.bitwise_count(f[same] ^ f[same + step]) <= max_distance]
            a.append(i[hit])
            b.append(i[hit + step])
        for k in np.flatnonzero(sizes > small):
            part = slice(starts[k], starts[k] + sizes[k])
            if found := _spanning_links(fps[part], ids[part], max_distance):
                x, y = np.array(found).T
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            if not len(rows):
                continue
            held.append(rows)
            rows = np.concatenate(held)
            cut = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
            whole = cut[-1] + 1 if len(cut) else 0
            if whole:
                yield from one(rows[:whole, :3], rows[:whole, 3])
                held = [rows[whole:]]
        if held:
            rows = np.concatenate(held)
            yield from one(rows[:, :3], rows[:, 3])

    return run


def fingerprint_links(nodes: DataFrame, max_distance: int = 4, tile: int = 4096) -> DataFrame:
    """``nodes(fp)``, distinct -> verified links ``(a, b)`` between fingerprints that span all linked groups."""
    parts = _blocks(max_distance)
    lists = [
        (F.lit(k) * F.lit(1 << 32) + F.shiftleft(_bits(*parts[i]), parts[j][1]) + _bits(*parts[j]))
        for k, (i, j) in enumerate(combinations(range(len(parts)), 2))
    ]
    members = nodes.select("fp", F.explode(F.array(*lists)).alias("list"))
    shared = members.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        members.join(shared, "list")
        .withColumn("tiles", tiles)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("list", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "fp")
    )
    return (
        dealt.repartition("list", "t1", "t2")
        .sortWithinPartitions("list", "t1", "t2")
        .mapInArrow(_verify(max_distance), "a long, b long")
    )


def _bits(shift: int, width: int):
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """``(id, h, fp)`` of every row and ``(fp, comp)`` of every fingerprint that a row carries."""
    marks = materialize(fingerprints(docs, id_col, text_col, width))
    nodes = materialize(marks.select("fp").distinct())
    found = connected_components(fingerprint_links(nodes, max_distance))
    groups = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component_id", "fp").alias("comp"))
    return marks, materialize(groups)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, kept.

    Null, empty and blank texts have the fingerprint zero and link like any other; texts of
    fewer than ``width`` words hash as one shingle. A row without id gets a fingerprint and
    takes part in no group (component_id null, not kept). Repeated ids each give a row and are grouped by their
    own texts. Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    marks, groups = _grouped(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width, max_distance)
    # fingerprints fold first, so a group's smallest id is a minimum over few rows
    least = marks.groupBy("fp").agg(F.min("id").alias("id")).join(groups, "fp").groupBy("comp").agg(F.min("id").alias("head"))
    found = marks.join(groups.join(least, "comp").select("fp", "head"), "fp").select("id", "fp", "head")
    loose = fingerprints(docs.where(F.col(id_col).isNull()), id_col, text_col, width).select("id", "fp", F.lit(None).cast("long").alias("head"))
    return found.union(loose).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head").alias("component_id"),
        F.coalesce(F.col("id") == F.col("head"), F.lit(False)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4) -> DataFrame:
    """One row of ``docs`` for each group of linked fingerprints, with all its columns: the smallest id.

    A group's rows are told apart by (id, hash of the text), so rows that share an id but not a group
    each stay; of rows equal in id and text one stays; rows without id all stay. Null texts are empty. An empty table gives an empty table.
    """
    marks, groups = _grouped(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width, max_distance)
    first = F.min(F.struct("id", "h")).alias("first")
    own = marks.groupBy("fp").agg(first).join(groups, "fp").groupBy("comp").agg(F.min("first").alias("first"))
    held = marks.join(groups.join(own, "comp").select("fp", "first"), "fp")
    stays = (F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h"))
    return without(docs, held.where(~stays).select(row_key(F.col("id"), F.col("h")).alias("key")), id_col, text_col)

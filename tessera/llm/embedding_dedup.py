"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors of one label fold into one weighted node first. Centroids are fitted on a
bounded sample; every node lives in its nearest cell. It visits its ``probes`` nearest cells and every cell
whose border is near: where the border of their homes parts two linked vectors, the nearer of them
lies no farther from it than half their chord, and it is enough that this one visits the other's home. ``spread`` sets
how many standard deviations of a link's length along one direction are covered; where that reaches the whole length
(few components, or ``spread=inf``) the search is exact. So a dense group that k-means splits over many cells is still
compared as a whole.

Within (label, cell) lists, the residents (nodes that live there) meet each other and the visitors; visitors
do not meet. Both are dealt into tiles and pairs of tiles are compared by matrix products, so a task holds two tiles
at most whatever the size of a cell. A pair that two cells could find is counted in one of them
only. Vectors go to the cells they visit in waves of cells, each of about the bytes of the vectors themselves, whose
shuffle is dropped before the next one; so disk does not grow with the number of visits. Tasks return link counts and
a spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialize, release

THRESHOLD = 0.93
#: scores that a fit holds at once
_SCORES = 1 << 23
#: a wave is no smaller than this, so that small tables take few
_LEAST_WAVE = 128 << 20


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit rows; an empty cell keeps its centroid."""
    k = max(1, min(k, len(sample)))
    centre = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        # in blocks, so that no more than some million scores are held at once
        cell = np.concatenate([(part @ centre.T).argmax(1) for part in np.array_split(sample, -(-len(sample) * k // _SCORES))])
        order = np.argsort(cell, kind="stable")
        own, start = np.unique(cell[order], return_index=True)
        total = np.add.reduceat(sample[order], start, axis=0)
        size = np.linalg.norm(total, axis=1)
        centre = centre.copy()
        centre[own[size > 0]] = total[size > 0] / size[size > 0, None]
    return centre


def visits(unit: np.ndarray, centre: np.ndarray, probes: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row, and which cells it visits (rows, cells), its home among them."""
    score = unit @ centre.T
    home = score.argmax(1)
    own = score[np.arange(len(unit)), home]
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centre[home] @ centre.T)))
    seen = own[:, None] - score <= reach * apart
    n = min(probes, len(centre))
    np.put_along_axis(seen, np.argpartition(-score, n - 1, axis=1)[:, :n], True, 1)
    seen[np.arange(len(unit)), home] = True
    return home, seen


def _assigner(centres, probes: int, threshold: float, spread: float, block: int = 512):
    """Rows (node, weight, label, h1, h2, vector) -> the same with length, home, other cells visited and the vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, sizes = batch.column(5), np.diff(batch.column(5).offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            flat = flat if flat.dtype == np.float32 else flat.astype(np.float64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                same = np.flatnonzero(sizes == dim)
                centre = centres.value.get(int(dim), np.zeros((1, dim)))
                reach = ((1 - threshold) / 2) ** 0.5 * min(1.0, spread / dim**0.5) + 1e-9
                for rows in np.array_split(same, -(-len(same) // block)):
                    own = flat[at[rows][:, None] + np.arange(dim)]
                    home, seen = visits(_unit(own.astype(np.float64)), centre, probes, reach)
                    seen[np.arange(len(rows)), home] = False
                    of, cell = np.nonzero(seen)
                    ends = np.searchsorted(of, np.arange(len(rows) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(k).take(pa.array(rows)) for k in range(5)),
                            pa.array(np.full(len(rows), dim, np.int32)),
                            pa.array(home.astype(np.int32)),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32))),
                            pa.array([x.tobytes() for x in own], pa.binary()),
                        ],
                        names=["node", "weight", "label", "h1", "h2", "dim", "home", "away", "raw"],
                    )

    return run


def _compare(threshold: float, dtype: type, block: int = 512):
    """One block of one list -> rows (node, links) and (node, other) of spanning links.

    Residents of tile ``i`` meet all other rows of the block, and each other in block 0.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, i, b = key[2], key[3], key[4]
        node, weight, tile, home = (rows[c].to_numpy() for c in ("node", "weight", "tile", "home"))
        lives = home == cell
        first = lives & (tile == i)
        left, others = np.flatnonzero(first), np.flatnonzero(~first)
        empty = pd.DataFrame({"node": node[:0], "links": node[:0], "other": node[:0]})
        if not len(left) or (b and not len(others)):
            return empty
        unit = _unit(np.frombuffer(b"".join(rows["raw"]), dtype).reshape(len(rows), -1).astype(np.float64))
        short = unit.astype(np.float32)
        right = np.concatenate([left, others]) if b == 0 else others
        # which homes of visitors each resident visits in turn
        homes, place = np.unique(home, return_inverse=True)
        away = rows["away"].to_numpy()
        flat = np.concatenate([np.zeros(0, np.int32), *(away[x] for x in left)]).astype(np.int64)
        owner = np.repeat(left, [len(away[x]) for x in left])
        near = np.minimum(np.searchsorted(homes, flat), len(homes) - 1)
        known = homes[near] == flat
        seen = np.sort(owner[known] * len(homes) + near[known])
        linked = np.zeros(len(rows), np.int64)
        head = np.arange(len(rows))

        def root(x: int) -> int:
            while head[x] != x:
                head[x] = head[head[x]]
                x = head[x]
            return x

        for part in np.array_split(left, -(-len(left) // block)):
            # single precision leaves out what is far below the threshold; the rest is decided in double precision
            p, q = np.nonzero(short[part] @ short[right].T >= threshold - 1e-4)
            x, y = part[p], right[q]
            once = (x < y) | ~first[y]
            # a pair with homes apart belongs to the smaller of the homes that saw both
            twice = home[y] < cell
            ask = x[twice] * len(homes) + place[y[twice]]
            spot = np.minimum(np.searchsorted(seen, ask), max(0, len(seen) - 1))
            twice[twice] = seen[spot] == ask if len(seen) else False
            x, y = x[once & ~twice], y[once & ~twice]
            hit = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", unit[x[k : k + 8192]], unit[y[k : k + 8192]]) >= threshold for k in range(0, len(x), 8192))])
            x, y = x[hit], y[hit]
            np.add.at(linked, x, weight[y])
            np.add.at(linked, y, weight[x])
            for u, v in _sparse(x, y) if len(x) else ():
                r, s = root(u), root(v)
                if r != s:
                    head[max(r, s)] = min(r, s)
        some = np.flatnonzero(linked)
        if not len(some):
            return empty
        top = np.array([root(x) for x in some], np.int64)
        return pd.DataFrame({"node": node[some], "links": linked[some], "other": node[top]})

    return run


def _sparse(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the same nodes as the many given: labels spread to a fixed point."""
    names = np.unique(np.concatenate([x, y]))
    a, b = np.searchsorted(names, x), np.searchsorted(names, y)
    mark = np.arange(len(names))
    while True:
        new = mark.copy()
        np.minimum.at(new, a, mark[b])
        np.minimum.at(new, b, mark[a])
        new = new[new]
        if (new == mark).all():
            return zip(names, names[mark], strict=True)
        mark = new


def _blocks() -> Column:
    """(i, b) of the blocks that a list's row goes to: see :func:`_compare`. Visitors' tile k meets each residents' tile in block k."""
    some = F.greatest("visiting", F.lit(1))
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    guest = F.transform(span(F.col("living")), lambda i: F.struct(i.alias("i"), F.col("tile").alias("b")))
    own = F.transform(span(some), lambda b: F.struct(F.col("tile").alias("i"), b.alias("b")))
    others = F.filter(span(F.col("living")), lambda o: o != F.col("tile"))
    pairs = F.transform(others, lambda o: F.struct(F.least(F.col("tile"), o).alias("i"), (some + F.greatest(F.col("tile"), o)).alias("b")))
    return F.when(F.col("home") == F.col("cell"), F.concat(own, pairs)).otherwise(guest)


def _found(placed: DataFrame, threshold: float, dtype: type, tile: int, wave_bytes: int | None) -> list[DataFrame]:
    """``(node, links, other)`` of all lists, a table for each wave of cells."""
    spark = placed.sparkSession
    place = ["label", "dim", "cell"]
    tiles = lambda n: F.ceil(n / tile).cast("int")
    living = placed.groupBy("label", "dim", F.col("home").alias("cell")).agg(tiles(F.count("*")).alias("living"))
    visiting = placed.select("label", "dim", F.explode("away").alias("cell")).groupBy(*place).agg(tiles(F.count("*")).alias("visiting"))
    # a cell where nobody lives has nothing to meet
    lists = materialize(living.join(visiting, place, "left").fillna(0, ["visiting"]))
    size = F.length("raw").cast("long")
    held, sent = placed.agg(F.sum(size), F.sum((F.size("away") + 1) * (size + 64))).first()
    waves = max(1, -(-int(sent or 0) // max(1, wave_bytes or max(_LEAST_WAVE, int(held or 0)))))
    out = []
    for wave in range(waves):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(waves)) == wave  # noqa: B023, E731
        listed = placed.select(
            "label", "dim", "node", "weight", "home", "raw", "away",
            F.explode(F.filter(F.concat(F.array("home"), "away"), mine)).alias("cell"),
        ).withColumn("away", F.when(F.col("home") == F.col("cell"), F.col("away")))
        parts = F.when(F.col("home") == F.col("cell"), F.col("living")).otherwise(F.greatest("visiting", F.lit(1)))
        dealt = (
            listed.join(lists, place)
            .withColumn("tile", F.pmod(F.xxhash64("node"), parts).cast("int"))
            .withColumn("block", F.explode(_blocks()))
            .select(*place, "block.i", "block.b", "node", "weight", "tile", "home", "away", "raw")
        )
        out.append(materialize(dealt.groupBy(*place, "i", "b").applyInPandas(_compare(threshold, dtype), "node long, links long, other long")))
        if wave + 1 < waves:
            release(spark)
    discard(lists)
    return out


def embedding_components(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    probes: int = 8,
    spread: float = 4.0,
    cell_sample: int = 8,
    most_cells: int = 16384,
    tile: int = 2048,
    wave_bytes: int | None = None,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link if their labels are equal and their cosine is at least ``threshold``. A vector
    that is null, zero, of null or non-finite components, without label or without id links with
    nothing and stands alone; vectors of different lengths never link. Repeated rows with one id
    count as vectors of their own. Cells number half the root of the vectors of one length, ``most_cells`` at most, and are
    fitted on ``cell_sample`` vectors for each. A wave of cells takes ``wave_bytes`` of vectors, all vectors' bytes (128 MB at least) where it is not given. Other columns are ignored. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    # two independent hashes lead a row back to its node, so that vectors are not dealt for that
    rows = rows.withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector", "label"))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    nodes = materialize(usable.groupBy("label", "vector").agg(F.min("id").alias("node"), F.count("*").alias("weight"), F.min("h1").alias("h1"), F.min("h2").alias("h2")))
    release(spark)
    # one row for each length of vectors; sixteen vectors make the first two cells
    sizes = nodes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") >= 16).collect()
    centres = {}
    for dim, n in sizes:
        cells = min(most_cells, int(n**0.5 / 2))
        share = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(2.0**30)
        drawn = nodes.where((F.size("vector") == dim) & (share * n <= 2 * cell_sample * cells)).orderBy(F.xxhash64("node"), "node").limit(cell_sample * cells)
        sample = _unit(np.array([r[0] for r in drawn.select("vector").collect()], np.float64))
        centres[dim] = fit_centroids(sample, cells)
    held = spark.sparkContext.broadcast(centres)
    placed = materialize(
        nodes.select("node", "weight", "label", "h1", "h2", "vector").mapInArrow(
            _assigner(held, probes, threshold, spread),
            f"node long, weight long, label {dict(nodes.dtypes)['label']}, h1 long, h2 long, dim int, home int, away array<int>, raw binary",
        )
    )
    dtype = np.float32 if dict(nodes.dtypes)["vector"] == "array<float>" else np.float64
    discard(nodes)
    waves = _found(placed, threshold, dtype, tile, wave_bytes)
    found = reduce(DataFrame.union, waves)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    heads = (
        placed.select("node", "weight", "h1", "h2")
        .join(links, "node", "left")
        .join(groups, "node", "left")
        .select(
            "h1", "h2",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component_id", "node").alias("component_id"),
        )
    )
    fits = F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector"))
    alike = rows.select("id", F.when(fits, F.col("h1")).alias("h1"), F.when(fits, F.col("h2")).alias("h2")).join(heads, ["h1", "h2"], "left")
    mine = F.col("id").isNotNull() & F.col("component_id").isNotNull()
    return alike.select(
        F.col("id").alias(id_col),
        F.when(mine, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(mine, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        (~mine | (F.col("id") == F.col("component_id"))).alias("kept"),
    )

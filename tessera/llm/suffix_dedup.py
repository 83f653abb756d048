"""Substring dedup over suffix ranks: distributed prefix doubling on the positions that can repeat.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Three steps:

1. Filter. Every window of ``length`` bytes picks the anchor among its ``GRAM``-byte strings with
   the smallest hash (leftmost of equals), so equal windows pick equal anchors. Windows in a row
   with one anchor form a segment. Segments meet by anchor hash: an anchor that
   occurs once has no repeated window; a segment whose bytes all occur earlier repeats as a
   whole; what is left, first occurrences of differing segments round one anchor, stays open.
2. Prefix doubling. Positions of open segments start with the ranks of their first
   seed (a quarter of ``length``) and of the seed after it. Spark sorts the rank pairs; equal pairs take one new
   rank, unique ones drop out; ranks at the offset reached then form the next pairs, and so on
   until a rank stands for ``length`` bytes. All but the first position of a rank repeat.

What step 1 decides by itself are whole segments equal in two 64-bit hashes (anchor and bytes); seeds are 64-bit hashes
too, and no byte is compared again.
3. Starts are merged to spans document by document, and the spans are cut out.

An anchor that many open segments share is dealt out by segment, so no key is hot in step
1; in step 2 a key is one string and its copies have been folded before. Only the filter, the
seed ranks and the cutting are numpy inside tasks; Spark deals, sorts and joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, in_order, materialize, release

GRAM_SHARE, HOT = 0.7, 64
_CHUNK = 1 << 17
_LOW = np.uint64(_CHUNK - 1)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


_UP, _DOWN = _powers(_BASE, _CHUNK + 1), _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of all strings of one chunk of bytes by differences of running sums."""

    def __init__(self, data: bytes):
        t = _TABLE[np.frombuffer(data, np.uint8)]
        self.sums = np.zeros(len(t) + 1, np.uint64)
        np.cumsum(t * _UP[: len(t)], out=self.sums[1:])

    def every(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * _DOWN[: len(self.sums) - n])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        v, n = np.minimum(v[:-n], v[n:]), 2 * n
    return np.minimum(v[: n - width], v[width - n :]) if n < width else v


def _chunks(us: list[int], raws: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end in chunks, long ones in overlapping pieces: (bytes, sizes, u, offset of piece)."""
    data, sizes, owners, offsets, held = [], [], [], [], 0
    for u, raw in zip(us, raws, strict=True):
        at = 0
        while len(raw) - at >= length:
            piece = raw[at : at + _CHUNK]
            if held and held + len(piece) > _CHUNK:
                yield b"".join(data), np.array(sizes), np.array(owners), np.array(offsets)
                data, sizes, owners, offsets, held = [], [], [], [], 0
            data.append(piece)
            sizes.append(len(piece))
            owners.append(u)
            offsets.append(at)
            held += len(piece)
            at += len(piece) - length + 1
    if held:
        yield b"".join(data), np.array(sizes), np.array(owners), np.array(offsets)


def segments(data: bytes, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, piece, first, count, digest) of each segment: windows in a row with one anchor."""
    from xxhash import xxh3_64_intdigest as digest

    grams = Hashes(data).every(gram)
    packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(packed, length - gram + 1) & _LOW).astype(np.int64)
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= ends[piece]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.flatnonzero(np.concatenate([(new | ~whole)[1:], [True]]) & whole) + 1
    found = np.array([digest(data[a:b]) for a, b in zip(first.tolist(), (stop + length - 1).tolist(), strict=True)], np.uint64)
    return grams[anchor[first]], piece[first], first, stop - first, found


_ENTRY = (("key", "<u8"), ("seg", "<u8"), ("u", "<i8"), ("lo", "<u4"), ("n", "<u4"), ("open", "u1"))


def _pack(rows: dict[str, np.ndarray], pick: np.ndarray) -> bytes:
    """Columns of entries by u and place; byte by byte, and documents as differences, so that the shuffle's compression finds the zeros."""
    parts = []
    for k, t in _ENTRY:
        x = rows[k][pick].astype(t)
        if k == "u":
            x = np.diff(x, prepend=x.dtype.type(0))
        parts.append(x.tobytes() if k in ("key", "seg") else x.view(np.uint8).reshape(len(x), -1).T.tobytes())
    return b"".join(parts)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in _ENTRY)
    parts: dict[str, list] = {k: [] for k, _ in _ENTRY}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, t in _ENTRY:
            size = np.dtype(t).itemsize
            x = np.frombuffer(blob, np.uint8, n * size, at)
            x = (x if k in ("key", "seg") else np.ascontiguousarray(x.reshape(size, n).T).ravel()).view(t)
            parts[k].append(np.cumsum(x) if k == "u" else x)
            at += n * size
    return {k: np.concatenate(v) for k, v in parts.items()}


def _fold(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows by key, segment and place; which of them are the first of a segment, and the number of segments round each one's key."""
    order = np.lexsort((rows["lo"], rows["u"], rows["seg"], rows["key"]))
    rows = {k: v[order] for k, v in rows.items()}
    turn = np.ones(len(order), bool)
    turn[1:] = rows["key"][1:] != rows["key"][:-1]
    lead = turn.copy()
    lead[1:] |= rows["seg"][1:] != rows["seg"][:-1]
    group = np.cumsum(turn) - 1
    return rows, lead, np.bincount(group, lead, minlength=1)[group] if len(group) else np.zeros(0)


def _spread(length: int, gram: int, buckets: int, group_bytes: int):
    """Texts -> (bucket, blob) of their segments, folded within each group of texts."""

    def emit(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        rows, lead, around = _fold(rows)
        # 0: compare by key; 1: known to repeat as a whole; 2: many segments round this key; 3: word of that to the key
        rows["open"] = np.where(~lead, 1, np.where(around >= HOT, 2, 0)).astype(np.uint8)
        hot = np.flatnonzero(lead & (around >= HOT))
        hot = hot[np.unique(rows["key"][hot], return_index=True)[1]]
        if len(hot):
            word = {k: v[hot] for k, v in rows.items()} | {"open": np.full(len(hot), 3, np.uint8)}
            rows = {k: np.concatenate([v, word[k]]) for k, v in rows.items()}
        # what is decided meets nothing any more, so it goes by its document: a passage in very many texts fills no bucket
        by = np.select([rows["open"] == 1, rows["open"] == 2], [rows["u"].astype(np.uint64), rows["seg"]], rows["key"] >> np.uint64(17))
        bucket = (by % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((rows["lo"], rows["u"], bucket))
        own, start = np.unique(bucket[order], return_index=True)
        blobs = [_pack(rows, part) for part in np.split(order, start[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for data, sizes, owners, offsets in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length):
                key, piece, first, count, seg = segments(data, sizes, length, gram)
                lo = first - (np.cumsum(sizes) - sizes)[piece] + offsets[piece]
                parts.append({"key": key, "seg": seg, "u": owners[piece], "lo": lo, "n": count})
                held += len(data)
                if held >= group_bytes:
                    yield from emit(parts)
                    parts, held = [], 0
        if parts:
            yield from emit(parts)

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets in a row -> (u, lo, n, open): windows that repeat as a whole, and those to be ranked."""

    def one(blobs: list[bytes]) -> pa.RecordBatch:
        rows = _unpack(blobs)
        known, word = rows["open"] == 1, rows["open"] == 3
        busy = np.unique(rows["key"][rows["open"] >= 2])
        rest, lead, around = _fold({k: v[~known & ~word] for k, v in rows.items()})
        follow = ~lead
        to_rank = lead & ((around > 1) | np.isin(rest["key"], busy))
        pick = follow | to_rank
        join = lambda k: np.concatenate([rows[k][known], rest[k][pick]])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(join("u").astype(np.int64)), pa.array(join("lo").astype(np.int32)), pa.array(join("n").astype(np.int32)),
                pa.array(np.concatenate([np.zeros(known.sum(), bool), to_rank[pick]])),
            ],
            names=["u", "lo", "n", "open"],
        )

    held: list[bytes] = []
    last = None
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != last and held:
                yield one(held)
                held = []
            last = bucket
            held.append(blob)
    if held:
        yield one(held)


def doubling_steps(length: int, seed: int) -> tuple[list[int], list[int]]:
    """Offsets at which ranks of 2 * seed bytes grow to ranks of ``length``, and the places after a start that this needs."""
    reach, steps, places = 2 * seed, [], {0}
    while reach < length:
        steps.append(min(reach, length - reach))
        reach += steps[-1]
    for step in reversed(steps):
        places |= {x + step for x in places}
    return steps, sorted(places)


def _seeds(seed: int, shifts: list[int]):
    """Texts with open windows -> (r1, r2, u, at): the ranks of the first two seeds of every place that the doubling needs."""
    both = 2 * seed

    def places(u: int, raw: bytes, lo: np.ndarray, n: np.ndarray) -> Iterator[list[np.ndarray]]:
        mark = np.zeros(len(raw) + 1, np.int32)
        for shift in shifts:
            np.add.at(mark, lo + shift, 1)
            np.add.at(mark, lo + n + shift, -1)
        wanted = np.cumsum(mark[:-1]) > 0
        step = _CHUNK - both
        for base in range(0, len(raw) - both + 1, step):
            at = np.flatnonzero(wanted[base : min(base + step, len(raw) - both + 1)])
            if len(at):
                ranks = Hashes(raw[base : base + _CHUNK]).every(seed).view(np.int64)
                yield [ranks[at], ranks[at + seed], np.full(len(at), u), (at + base).astype(np.int32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for u, raw, los, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in places(u, raw, np.array(los), np.array(ns)):
                    out.append(part)
                    held += len(part[0])
                    if held >= 100_000:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    return run


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["r1", "r2", "u", "at"])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pairs -> (u, at, rank) of the pairs that occur more than once."""
    from pyspark import TaskContext

    rank = TaskContext.get().partitionId() << 40
    held = None
    for batch in batches:
        r1, r2, u, at = _columns(batch)
        if held is not None:
            r1, r2, u, at = (np.concatenate(x) for x in zip(held, (r1, r2, u, at), strict=True))
        if not len(r1):
            continue
        turn = np.ones(len(r1), bool)
        turn[1:] = (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])
        cut = np.flatnonzero(turn)[-1]
        held = [r1[cut:], r2[cut:], u[cut:], at[cut:]]
        if cut:
            yield _ranked(turn[:cut], u[:cut], at[:cut], rank)
            rank += cut
    if held is not None:
        turn = np.zeros(len(held[0]), bool)
        turn[0] = True
        yield _ranked(turn, held[2], held[3], rank)


def _ranked(turn: np.ndarray, u: np.ndarray, at: np.ndarray, rank: int) -> pa.RecordBatch:
    more = ~turn
    more[:-1] |= ~turn[1:]
    return pa.RecordBatch.from_arrays(
        [pa.array(u[more]), pa.array(at[more]), pa.array((np.cumsum(turn) + rank)[more])], names=["u", "at", "rank"]
    )


def _doubled(offset: int):
    """(u, at, rank) by u and place -> pairs of the ranks at a place and ``offset`` after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        for batch in batches:
            u, at, rank = (np.concatenate(x) for x in zip(held, _columns(batch), strict=True))
            if not len(u):
                continue
            yield from pairs(u, at, rank, (int(u[-1]), int(at[-1])))
            ready = (u != u[-1]) | (at.astype(np.int64) + offset <= at[-1])
            keep = np.flatnonzero(~ready)[0] if not ready.all() else len(u)
            held = [u[keep:], at[keep:], rank[keep:]]
        # what is held lies too close to the end of the last document to have a partner

    def pairs(u, at, rank, last) -> Iterator[pa.RecordBatch]:
        place = (np.cumsum(np.concatenate([[0], u[1:] != u[:-1]])) << 32) + at
        seek = np.searchsorted(place, place + offset)
        ready = (u != last[0]) | (at.astype(np.int64) + offset <= last[1])
        hit = np.flatnonzero(ready & (seek < len(place)) & (place[np.minimum(seek, len(place) - 1)] == place + offset))
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rank[hit]), pa.array(rank[seek[hit]]), pa.array(u[hit]), pa.array(at[hit])], names=["r1", "r2", "u", "at"]
            )

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pairs -> (u, lo, n) of all but the first of each pair."""
    last = None
    for batch in batches:
        r1, r2, u, at = _columns(batch)
        if not len(r1):
            continue
        same = np.zeros(len(r1), bool)
        same[1:] = (r1[1:] == r1[:-1]) & (r2[1:] == r2[:-1])
        same[0] = last == (r1[0], r2[0])
        last = (r1[-1], r2[-1])
        yield pa.RecordBatch.from_arrays([pa.array(u[same]), pa.array(at[same]), pa.array(np.ones(same.sum(), np.int32))], names=["u", "lo", "n"])


def _sorted_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.repartition("r1", "r2").sortWithinPartitions("r1", "r2", "u", "at")


def spans_of(n_bytes: int, los: list[int], ns: list[int], length: int) -> np.ndarray:
    """Maximal runs [start, end) of the bytes that windows starting in the given ranges cover."""
    mark = np.zeros(n_bytes + 1, np.int64)
    lo, n = np.array(los, np.int64), np.array(ns, np.int64)
    np.add.at(mark, lo, 1)
    np.add.at(mark, lo + n + length - 1, -1)
    gone = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
    return np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)


def _cut_out(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, raw, los, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = spans_of(len(raw), los, ns, length) if los else np.zeros((0, 2), np.int64)
                kept, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((doc, len(raw), int((spans[:, 1] - spans[:, 0]).sum()), spans.tolist(), kept.hexdigest()))
            doc, size, removed, spans, sha = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(sha, pa.string())],
                names=["id", "n_bytes", "n_removed", "spans", "kept_sha256"],
            )

    return run


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, seed: int | None = None, group_bytes: int = 16 << 20
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, spans, kept_sha256.

    ``spans`` are the removed runs [start, end) in bytes of the original text; the hash is that of the
    bytes left. Null text is empty. Documents are ordered by id, null last, then by text; of repeated
    rows each is a document of its own, so the second of two equal ones goes as a whole if it has
    ``length`` bytes. Other columns are ignored; an empty table gives an empty table. ``seed`` is the length of the
    strings whose ranks the doubling starts from (64-bit hashes; a quarter of ``length`` unless given).
    """
    seed = seed or length // 4
    if length < 8 or not 0 < 2 * seed <= length:
        raise ValueError("length is eight at least, and two seeds fit into it")
    spark = docs.sparkSession
    gram = max(length // 4, int(length * GRAM_SHARE))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = in_order(docs, id_col, text_col)
    judged = materialize(
        texts.select("u", "raw")
        .mapInArrow(_spread(length, gram, buckets, group_bytes), "bucket int, blob binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_judge, "u long, lo int, n int, open boolean"),
        "zstd",
    )
    release(spark)
    todo = judged.where("open").groupBy("u").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    steps, shifts = doubling_steps(length, seed)
    pair = "r1 long, r2 long, u long, at int"
    pairs, ranked = texts.select("u", "raw").join(todo.hint("shuffle_hash"), "u").mapInArrow(_seeds(seed, shifts), pair), None
    for step in steps:
        before, ranked = ranked, materialize(_sorted_pairs(pairs).mapInArrow(_rerank, "u long, at int, rank long"), "zstd")
        discard(before)
        release(spark)
        pairs = ranked.repartition("u").sortWithinPartitions("u", "at").mapInArrow(_doubled(step), pair)
    later = materialize(_sorted_pairs(pairs).mapInArrow(_later, "u long, lo int, n int"), "zstd")
    discard(ranked)
    release(spark)
    starts = judged.where("not open").select("u", "lo", "n").union(later)
    marks = starts.groupBy("u").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    found = texts.join(marks.hint("shuffle_hash"), "u", "left").select("id", "raw", "lo", "n")
    schema = "id long, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string"
    return found.mapInArrow(_cut_out(length), schema).withColumnRenamed("id", id_col)


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

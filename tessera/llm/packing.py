"""Harmonic packing of token ids into sequences, each worker for itself and without a shuffle.

A document's ids are cut into pieces of exactly ``capacity / 2**j`` ids, largest first, down to
``finest``; what is left over is one short piece. A piece of length n belongs to the
reciprocal-capacity class ``k = capacity // n``, and a sequence of class k is closed with its k-th
piece. Classes of cut pieces fill their sequences to the last id; the short pieces of
class k leave less than 1/(k+1) of theirs. At the end of a task, what its open sequences
hold is cut again into full sequences, and the last ids into powers of two, which need no
padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, in_groups

CAPACITY, FINEST = 2048, 128
SCHEMA = "id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut_lengths(n: int, capacity: int = CAPACITY, finest: int = FINEST) -> list[int]:
    """Lengths of the pieces of n ids: full ones, halves, ..., and one of what is left."""
    sizes = [capacity] * (n // capacity)
    n %= capacity
    size = capacity
    while size > finest:
        size //= 2
        if n >= size:
            sizes.append(size)
            n -= size
    return sizes + [n] * (n > 0)


class Packer:
    """Open sequences of one worker, one for each class."""

    def __init__(self, worker: int, capacity: int = CAPACITY, finest: int = FINEST):
        self.next, self.capacity, self.finest = worker << 40, capacity, finest
        self.open: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        for n in cut_lengths(total, self.capacity, self.finest):
            k = self.capacity // n
            held = self.open.setdefault(k, [])
            held.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            if len(held) == k:
                self._close(self.open.pop(k))
            start += n

    def finish(self) -> None:
        """Cut what open sequences hold into full ones, and the rest into powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        n = sum(len(p[2]) // 4 for p in left)
        rooms = [self.capacity] * (n // self.capacity)
        rooms += [1 << i for i in reversed(range((n % self.capacity).bit_length())) if n % self.capacity >> i & 1]
        at = 0
        for room in rooms:
            pieces = []
            while room:
                doc, start, ids, total = left[at]
                part = ids[: 4 * room]
                pieces.append((doc, start, part, total))
                room -= len(part) // 4
                left[at] = (doc, start + len(part) // 4, ids[len(part) :], total)
                at += len(part) == len(ids)
            self._close(pieces)

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            doc, start, ids, total, seq, offset = zip(*self.out, strict=True)
            self.out = []
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [long(doc), long(start), pa.array(ids, pa.binary()), long(total), long(seq), long(offset)],
                names=["id", "start", "ids", "doc_tokens", "sequence_id", "offset"],
            )


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 1, kind: str = "word", capacity: int = CAPACITY, finest: int = FINEST,
) -> DataFrame:
    """One row per piece: id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``capacity`` is a power of two. Null or empty text is the end id alone; a null id stays
    null; repeated rows are documents of their own; other columns are ignored. An empty table
    gives an empty table. Sequence ids are unique: a worker's number and a running number.
    """
    assert capacity & (capacity - 1) == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, packer = encoder(tokenizer, kind), Packer(TaskContext.get().partitionId(), capacity, finest)
        end = np.array([end_id], "<u4").tobytes()
        held = 0
        for batch in batches:
            coded = (x for group in in_groups(batch.column(1)) for x in ids_of.encode_all(group))
            for doc, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids += end
                packer.add(doc, ids)
                held += len(ids)
                if held > 4_000_000:
                    yield from packer.taken()
                    held = 0
        packer.finish()
        yield from packer.taken()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


def piece_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        id_col, "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )

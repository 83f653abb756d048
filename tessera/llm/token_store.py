"""Token-id shards with a minimal perfect hash index, and readers for them.

A shard is two files. ``*.ids``: the raw ids of the shard's documents in ascending key
order, little-endian, two bytes each for vocabularies of up to 65,536 ids, else four. ``*.mph``: a header, the levels of a minimal perfect hash
over the shard's keys, one record (fingerprint, start, length) for each hash slot, and the
keys in order. A lookup hashes the key, probes one bit on each level until one is set,
takes the bit's rank as slot, compares the stored fingerprint and reads the ids at the
record's offset: constant expected time, no search.

A key is (doc_id, occurrence): repeated ids are numbered within a shard, so its keys are unique. Files are written
under a name of the attempt and then moved in place, so a task that is run again after the loss of an
executor leaves one whole shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, shared_folder
from .tokens import encoder, in_groups, narrowest

MAGIC = b"TIDS0002"
_HEAD = struct.Struct("<8sQQII")
RECORD = np.dtype([("fingerprint", "<u8"), ("start", "<u8"), ("length", "<u8")])
KEY = np.dtype([("doc_id", "<i8"), ("occurrence", "<u4"), ("is_null", "<u4")])
GAMMA = 2
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser; different salts give independent hashes."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt + 1) * _MIX[2] & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
        return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray) -> np.ndarray:
    low = keys["doc_id"].astype(np.int64).view(np.uint64)
    high = keys["occurrence"].astype(np.uint64) | keys["is_null"].astype(np.uint64) << np.uint64(32)
    return _mix(low, 0) ^ _mix(high, 1)


@dataclass
class PerfectHash:
    """Levels of bit arrays: a key belongs to the first level on which no other key left shares its bit."""

    levels: list[np.ndarray]
    before: list[np.ndarray]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            n = max(64, -(-GAMMA * len(left) // 64) * 64)
            at = (_mix(left, 2 + len(levels)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls.ranked(levels)

    @classmethod
    def ranked(cls, levels: list[np.ndarray]) -> PerfectHash:
        before, total = [], 0
        for bits in levels:
            words = np.bitwise_count(bits.view("<u8")).astype(np.int64)
            before.append(total + np.concatenate([[0], np.cumsum(words)]))
            total = int(before[-1][-1])
        return cls(levels, before)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level holds it."""
        out, todo = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for k, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            if not len(todo):
                break
            words = bits.view("<u8")
            at = _mix(hashes[todo], 2 + k) % np.uint64(8 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[hit], bit[hit]
            out[todo[hit]] = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1)))
            todo = todo[~hit]
        return out


def index_bytes(keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    hashes = key_hash(keys)
    mph = PerfectHash.build(hashes)
    records = np.zeros(len(keys), RECORD)
    slot = mph.slots(hashes)
    records["fingerprint"][slot] = _mix(hashes, 999)
    records["start"][slot], records["length"][slot] = starts, lengths
    head = _HEAD.pack(MAGIC, len(keys), int(lengths.sum()), len(mph.levels), width)
    sizes = struct.pack(f"<{len(mph.levels)}Q", *map(len, mph.levels))
    return b"".join([head, sizes, *(x.tobytes() for x in mph.levels), records.tobytes(), keys.tobytes()])


class Shard:
    """Keyed access to one shard's ids."""

    def __init__(self, ids: bytes | memoryview, index: bytes):
        magic, n, self.n_ids, n_levels, width = _HEAD.unpack_from(index)
        if magic != MAGIC or len(ids) != width * self.n_ids:
            raise ValueError("not a whole shard")
        at = _HEAD.size + 8 * n_levels
        levels = []
        for size in struct.unpack_from(f"<{n_levels}Q", index, _HEAD.size):
            levels.append(np.frombuffer(index, np.uint8, size, at))
            at += size
        self.mph = PerfectHash.ranked(levels)
        self.records = np.frombuffer(index, RECORD, n, at)
        self.keys = np.frombuffer(index, KEY, n, at + self.records.nbytes)
        self.ids = np.frombuffer(ids, f"<u{width}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) in ids for each key; length -1 where the shard doesn't hold it."""
        hashes = key_hash(keys)
        slot = self.mph.slots(hashes)
        if not len(self.records):
            return np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        found = self.records[np.maximum(slot, 0)]
        known = (slot >= 0) & (found["fingerprint"] == _mix(hashes, 999))
        return found["start"].astype(np.int64), np.where(known, found["length"].astype(np.int64), -1)

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        key = np.array([(doc_id or 0, occurrence, doc_id is None)], KEY)
        start, length = self.find(key)
        return None if length[0] < 0 else self.ids[start[0] : start[0] + length[0]]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, blobs: list[bytes]) -> None:
    """Write whole, then move in place: the name never holds half a file."""
    files, path = _open(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        for x in blobs:
            out.write(x)
    files.move(part, path)


def _writer(folder: str, tokenizer: str, kind: str, dtype: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, worker = encoder(tokenizer, kind, dtype), TaskContext.get().partitionId()
        end = np.array([end_id], dtype).tobytes()
        width = len(end)
        keys: list[tuple] = []
        blobs: list[bytes] = []
        last, seen, held, number = object(), 0, 0, 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/shard-{worker:07d}-{number:05d}"
            lengths = np.array([len(b) // width for b in blobs], np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            _put(f"{name}.ids", blobs)
            _put(f"{name}.mph", [index_bytes(np.array(keys, KEY), starts, lengths, width)])
            return pa.RecordBatch.from_pydict(
                {"worker": [worker], "number": [number], "path": [name], "n_docs": [len(keys)], "n_ids": [int(lengths.sum())]},
                schema=pa.schema([("worker", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        for batch in batches:
            coded = (x for group in in_groups(batch.column(1)) for x in ids_of.encode_all(group))
            for doc, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                seen = seen + 1 if doc == last else 0
                last = doc
                ids += end
                keys.append((doc or 0, seen, doc is None))
                blobs.append(ids)
                held += len(ids)
                if held >= shard_bytes:
                    yield close()
                    keys, blobs, held, number = [], [], 0, number + 1
                    last = object()
        if keys:
            yield close()

    return run


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, kind: str = "byte", shard_bytes: int = 16 << 20,
) -> DataFrame:
    """Write all documents' ids below ``folder`` in ascending id order; the manifest, one row per shard.

    ``first_id`` counts the ids of all shards before. Null ids come first; repeated ids are in order
    of a hash of their texts, and may reach over several shards. Null text is the end id alone. Other columns are ignored; an empty table
    writes nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # by text hash within an id, so that null or repeated ids do not meet in one task
    place = [F.col("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place, "text")
    written = materialize(
        ordered.mapInArrow(
            _writer(folder, tokenizer, kind, narrowest(tokenizer), end_id, shard_bytes), "worker int, number int, path string, n_docs long, n_ids long"
        )
    )
    # one row per shard, some megabytes each: the only rows that meet in one task
    before = Window.orderBy("worker", "number").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files, at = _open(path)
            with files.open_input_stream(f"{at}.ids") as f, files.open_input_stream(f"{at}.mph") as g:
                shard = Shard(f.read(), g.read())
            start, length = shard.find(shard.keys)
            if (length < 0).any():
                raise ValueError(f"{path}: the index misses keys of its own")
            crc = [zlib.crc32(shard.ids[a : a + n].astype("<u4")) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.keys["doc_id"].astype(np.int64), mask=shard.keys["is_null"] > 0),
                    pa.array(start + first), pa.array(length), pa.array(crc, pa.int64()),
                ],
                names=["id", "start", "n_tokens", "ids_crc32"],
            )


def read_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document, looked up by key in the files: id, start, n_tokens, ids_crc32."""
    dealt = manifest.select("path", "first_id").repartition("path")
    return dealt.mapInArrow(_reader, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_output(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Write the shards to the shared folder and read every document back."""
    folder = shared_folder(docs.sparkSession)
    return read_shards(write_shards(docs, folder, tokenizer, id_col, text_col, **how), id_col)

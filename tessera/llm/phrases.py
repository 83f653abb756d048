"""Collocations: phrases of two to five words whose parts stand together far more often than apart.

Words that occur ``least`` times in a language get ids; pieces break at all other words, since no phrase of ``least``
occurrences can hold one. Each place with two ids in a row gives one binary key of fixed width: the ids of up to
``longest`` words from there on, most significant byte first, so that byte order is word order and a language's keys are
its own. Tasks sort their keys by radix passes and count runs before anything is shuffled. Keys are then dealt out by
ranges; a range is sorted the same way, and one pass over it counts the runs of every prefix, which are the phrases of
each length. A run that touches the border of a range may go on in the next one, so its part is kept whatever its size,
and parts are added up.

Pairs of words are counted first. A longer phrase of ``least`` occurrences holds only pairs that have as many, so for the second count
pieces also break at all other pairs. Which pairs are frequent goes to the tasks as a bitmap of bounded size; where two pairs share a bit, a piece is merely not
broken, and no count changes.

Ids go to the tasks as one table while it is below ``most_broadcast`` bytes. Beyond that the distinct words of each
document meet the table by a join, and a document is numbered by what it got.

Null texts count as empty, a null language is ``und``; ids, repeated rows and further columns do not matter; an empty
table has no phrases. A text is cut as a whole, however long.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize, release

#: fixed values: bytes that end a piece, and those that part words
_BREAKS, _BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
#: A-Z in lower case, every break as one mark, every blank as a space
_MARK = b"."
_FOLD = bytes(46 if b in _BREAKS else 32 if b in _BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: distinct words or keys that a task holds before it passes counts on, and keys of a range
_HELD, _RANGE = 1 << 18, 1 << 19
#: ids in the keys that a task sorts at a time
_SORTED = 1 << 21
#: bits of the bitmap of frequent pairs: for each pair, and at most
_PAIR_BITS, _MOST_BITS = 16, 1 << 29


def _words(raw: bytes) -> list[bytes]:
    """Words in order, with a mark at each end of a piece."""
    return raw.translate(_FOLD).replace(_MARK, b" . ").split()


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("raw"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, c); a null word carries the number of all words."""
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(_MARK, None)
            words = [None, *counts]
            c = [sum(counts.values()), *counts.values()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(words, pa.binary()), pa.array(c, pa.int64())], names=["lang", "word", "c"])
        held.clear()

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held[lang].update(_words(raw.as_py()))
            if sum(map(len, held.values())) > _HELD:
                yield from out()
    yield from out()


def frequent_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(id, lang, word, c)`` of every word with ``least`` occurrences in a language, ids from 1, and ``(lang, n)``."""
    partial = _rows(docs, text_col, lang_col).mapInArrow(_count_words, "lang string, word binary, c long")
    counts = partial.groupBy("lang", "word").agg(F.sum("c").alias("c")).where(F.col("word").isNull() | (F.col("c") >= least))
    held = materialize(counts.withColumn("at", F.monotonically_increasing_id()))
    # the number of rows before each writing task's first: one value a task
    task = F.shiftright("at", 33)
    before, total = [], 0
    for r in held.groupBy(task.alias("task")).count().orderBy("task").collect():
        before.append((int(r[0]), total))
        total += r[1]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "task long, base long"))
    numbered = held.where(F.col("word").isNotNull()).withColumn("task", task).join(offsets, "task")
    ids = numbered.select((F.col("base") + F.col("at") - F.shiftleft("task", 33) + 1).alias("id"), "lang", "word", "c")
    return materialize(ids), held.where(F.col("word").isNull()).select("lang", F.col("c").alias("n"))


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their columns, first column first: stable passes over 16-bit digits from the last on."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, 64, 16):
            if not (column >> np.uint64(shift)).any():
                break
            digit = (column >> np.uint64(shift)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows sorted, equal ones as one with their summed count."""
    if not len(counts):
        return columns, counts
    order = radix_order(columns)
    columns, counts = [c[order] for c in columns], counts[order]
    turn = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    return [c[turn] for c in columns], np.add.reduceat(counts, np.flatnonzero(turn))


def _packed(columns: list[np.ndarray], width: int) -> pa.Array:
    """Ids side by side, ``width`` bytes each, most significant first."""
    rows = np.stack([np.ascontiguousarray(c.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - width :] for c in columns], 1)
    flat = np.ascontiguousarray(rows.reshape(len(columns[0]), -1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _unpacked(keys: pa.Array, longest: int, width: int) -> list[np.ndarray]:
    size = longest * width
    flat = np.frombuffer(keys.buffers()[2], np.uint8)[keys.offset * size : (keys.offset + len(keys)) * size].reshape(len(keys), longest, width)
    wide = np.zeros((len(keys), longest, 8), np.uint8)
    wide[:, :, 8 - width :] = flat
    ids = wide.view(">u8").reshape(len(keys), longest)
    return [ids[:, k].astype(np.uint64) for k in range(longest)]


class Pairs:
    """A bitmap of pairs of ids."""

    def __init__(self, n_bits: int):
        self.shift = np.uint64(64 - (n_bits.bit_length() - 1))
        self.bits = np.zeros(n_bits >> 3, np.uint8)

    def _at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)) >> self.shift

    def add(self, a: np.ndarray, b: np.ndarray) -> Pairs:
        at = self._at(a, b)
        np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
        return self

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self._at(a, b)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def merge(self, other: Pairs | None) -> Pairs:
        if other is not None:
            self.bits |= other.bits
        return self


def frequent_pairs(found: DataFrame, width: int) -> Pairs:
    """The bitmap of all keys in ``found(key)``: each task sets its own bits, a tree merges them."""
    n_bits = min(_MOST_BITS, 1 << max(10, (_PAIR_BITS * found.count() - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pairs(n_bits)
        for batch in batches:
            if batch.num_rows:
                own.add(*_unpacked(batch.column(0), 2, width))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["own"])

    partial = found.select("key").coalesce(64).mapInArrow(run, "own binary").rdd.map(lambda r: pickle.loads(r[0]))
    return partial.treeAggregate(Pairs(n_bits), lambda a, b: a.merge(b), lambda a, b: a.merge(b))


def _windows(ids: list[int], longest: int, pairs: Pairs | None) -> list[np.ndarray]:
    """For each id: the ids from there to the next break, ``longest`` at most, then zeros; two of them at least, three where pairs are known."""
    n = len(ids)
    padded = np.zeros(n + longest, np.uint64)
    padded[:n] = ids
    columns = [padded[k : k + n].copy() for k in range(longest)]
    for before, column in zip(columns, columns[1:], strict=False):
        column[before == 0] = 0
        if pairs is not None:
            column[~pairs.has(before, column)] = 0
    inside = columns[1 if pairs is None else 2] > 0
    return [c[inside] for c in columns]


def _counted(parts: Iterator[list[np.ndarray]], longest: int, width: int) -> Iterator[pa.RecordBatch]:
    """(key, c): windows of a task, sorted and counted by runs."""

    def out(held: list) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        columns, c = _runs(columns, np.ones(len(columns[0]), np.int64))
        for at in range(0, len(c), 1 << 17):
            part = slice(at, at + (1 << 17))
            yield pa.RecordBatch.from_arrays([_packed([x[part] for x in columns], width), pa.array(c[part])], names=["key", "c"])

    held, size = [], 0
    for columns in parts:
        held.append(columns)
        size += len(columns[0])
        if size * longest > _SORTED:
            yield from out(held)
            held, size = [], 0
    if size:
        yield from out(held)


def _keys_by_table(table, longest: int, width: int, pairs=None):
    """Rows (lang, raw) -> (key, c), ids from a table held by each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = table.value, pairs and pairs.value

        def parts() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = known.get(lang, {})
                    yield _windows(list(map(own.get, _words(raw.as_py()), repeat(0))), longest, kept)

        return _counted(parts(), longest, width)

    return run


def _keys_by_row(longest: int, width: int, pairs=None):
    """Rows (raw, words, ids) -> (key, c), ids from the row itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pairs and pairs.value

        def parts() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for raw, words, ids in zip(*(batch.column(k) for k in range(3)), strict=True):
                    own = dict(zip(words.as_py(), ids.as_py(), strict=True))
                    yield _windows(list(map(own.get, _words(raw.as_py()), repeat(0))), longest, kept)

        return _counted(parts(), longest, width)

    return run


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted({*_words(raw.as_py())} - {_MARK}) for raw in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.binary()))], names=["u", "lang", "words"])


def _numbered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(raw, word, id): each document with its distinct words' ids; Spark splits what a very frequent word gathers in that join."""
    held = materialize(rows.select(F.monotonically_increasing_id().alias("u"), "lang", "raw"))
    asked = held.mapInArrow(_distinct_words, "u long, lang string, words array<binary>").select("u", "lang", F.explode("words").alias("word"))
    found = asked.join(words.select("id", "lang", "word"), ["lang", "word"]).groupBy("u").agg(F.collect_list(F.struct("word", "id")).alias("own"))
    return materialize(held.join(found, "u").select("raw", "own.word", "own.id"))


def _prefix_runs(shortest: int, longest: int, width: int, least: int):
    """A range of keys -> (key, c) of each prefix of ``shortest`` words or more with ``least`` occurrences, or at a border of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((_unpacked(batch.column(0), longest, width), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 4 * _RANGE:
                held = [_runs([np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]))]
                size = len(held[0][1])
        if not held:
            return
        columns, c = _runs([np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]))
        turn = np.zeros(len(c), bool)
        turn[0] = True
        turn[1:] |= columns[0][1:] != columns[0][:-1]
        for k in range(1, longest):
            turn[1:] |= columns[k][1:] != columns[k][:-1]
            if k + 1 < shortest:
                continue
            starts = np.flatnonzero(turn)
            sums = np.add.reduceat(c, starts)
            keep = sums >= least
            keep[0] = keep[-1] = True
            keep &= columns[k][starts] > 0
            if keep.any():
                at = starts[keep]
                yield pa.RecordBatch.from_arrays([_packed([x[at] for x in columns[: k + 1]], width), pa.array(sums[keep])], names=["key", "c"])

    return run


def _id_key(id_: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(id_), 2 * width, "0"))


def phrase_counts(rows: DataFrame, words: DataFrame, longest: int, least: int, most_broadcast: int, width: int) -> DataFrame:
    """``(key, a)`` of every phrase of two to ``longest`` words with ``least`` occurrences."""
    spark = rows.sparkSession
    size = words.agg(F.sum(F.length("word") + F.length("lang") + 100)).first()[0] or 0
    if size <= most_broadcast:
        table: dict[str, dict[bytes, int]] = defaultdict(dict)
        for r in words.select("id", "lang", "word").toLocalIterator():
            table[r.lang][bytes(r.word)] = r.id
        shared = spark.sparkContext.broadcast(dict(table))
        numbered, keyed = rows, lambda n, pairs: _keys_by_table(shared, n, width, pairs)
    else:
        numbered, keyed = _numbered(rows, words), lambda n, pairs: _keys_by_row(n, width, pairs)

    def counted(n: int, pairs, shortest: int) -> DataFrame:
        keys = materialize(numbered.mapInArrow(keyed(n, pairs), "key binary, c long"), "zstd")
        ranges = max(spark.sparkContext.defaultParallelism, -(-keys.count() // _RANGE))
        dealt = keys.repartitionByRange(ranges, "key").mapInArrow(_prefix_runs(shortest, n, width, least), "key binary, c long")
        found = materialize(dealt.groupBy("key").agg(F.sum("c").alias("a")).where(F.col("a") >= least))
        discard(keys)
        return found

    pairs = counted(2, None, 2)
    if longest == 2:
        return pairs
    release(spark)  # the first count's shuffle is not read again
    return pairs.union(counted(longest, spark.sparkContext.broadcast(frequent_pairs(pairs, width)), 3))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, cover: int = 100, top: int = 2000, most_broadcast: int = 64 << 20) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases.

    a, l and r count the phrase and its two parts at the cut of the lowest score (the earliest of equal ones), n all
    words; score is the whole part of 1000 a n / (l r). A phrase goes if a longer one that holds it has ``cover`` per cent of its
    occurrences. Ranks fall by score, then a, then rise by the bytes of the phrase.
    """
    words, totals = frequent_words(docs, text_col, lang_col, least)
    width = max(4, -(-(words.agg(F.max("id")).first()[0] or 0).bit_length() // 8))
    found = phrase_counts(_rows(docs, text_col, lang_col), words, longest, least, most_broadcast, width)
    n_words = (F.length("key") / width).cast("int")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n_words - 1), lambda m: F.transform(F.sequence(F.lit(0), n_words - m), lambda s: F.substring(F.col("key"), s * width + 1, m * width))))
    inside = found.where(n_words > 2).select(F.explode(inner).alias("key"), "a").groupBy("key").agg(F.max("a").alias("b"))
    left = found.join(inside, "key", "left").where(F.coalesce(100 * F.col("b") < cover * F.col("a"), F.lit(True))).drop("b")
    counts = found.select("key", F.col("a").alias("c"), F.lit(None).cast("string").alias("lang")).union(words.select(_id_key(F.col("id"), width), "c", "lang"))
    cuts = left.select("key", "a", F.explode(F.sequence(F.lit(1), n_words - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.substring(F.col("key"), F.lit(1), F.col("k") * width), "rest": F.substring(F.col("key"), F.col("k") * width + 1, F.length("key"))})
    heads = counts.select(F.col("key").alias("head"), F.col("c").alias("l"), "lang")
    rests = counts.select(F.col("key").alias("rest"), F.col("c").alias("r"))
    cuts = cuts.join(heads, "head").join(rests, "rest")
    whole = cuts.groupBy("key").agg(F.first("a").alias("a"), F.max("lang").alias("lang"), F.collect_list(F.struct("k", "l", "r")).alias("cuts")).join(totals, "lang")
    wide = "cast({} as decimal(18, 0))".format
    score = f"({wide('a')} * (cast(n as decimal(18, 0)) * 1000)) div ({wide('x.l')} * {wide('x.r')})"
    least_cut = F.expr(f"array_min(transform(cuts, x -> struct({score} as score, x.k as k, x.l as l, x.r as r)))")
    scored = whole.withColumn("cut", least_cut).select("lang", "key", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc()]
    first = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place")
    first = materialize(first)
    parts = first.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), n_words - 1), lambda s: F.substring(F.col("key"), s * width + 1, F.lit(width)))).alias("at", "own"))
    spelled = parts.join(words.select(_id_key(F.col("id"), width).alias("own"), F.col("word").cast("string").alias("word")), "own")
    spelled = spelled.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    ranked = first.join(spelled, "key").withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

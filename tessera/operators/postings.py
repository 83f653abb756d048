"""Asked terms in texts: counts made where a text is read, and the best rows of each question by blocks of rows.

No word of a text is shuffled. A task knows the asked terms, gives each row one record of the terms it holds, and only these records
move, each to its block. A block meets all questions and passes on no more than its best ``k`` of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import text as T
from tessera.sources.shared import written

#: terms that a task knows at once (more of them take more passes), words that it looks at at once, rows of a block, terms of questions that meet it at once
MOST_TERMS, MOST_WORDS, MOST_ROWS, MOST_ASKED = 1 << 20, 1 << 21, 1 << 14, 1 << 20


class _Vocabulary:
    """Codes of all words in the terms, the single words among the terms, and the phrases as codes."""

    def __init__(self, terms: list[tuple[int, str]]):
        self.code: dict[str, int] = {}
        self.number = np.array([n for n, _ in terms], np.int64)
        parts = [[self.code.setdefault(w, len(self.code)) for w in term.split(" ")] for _, term in terms]
        self.single = np.full(len(self.code), -1, np.int64)
        for nth, codes in enumerate(parts):
            if len(codes) == 1:
                self.single[codes[0]] = nth
        self.phrases = [(nth, codes) for nth, codes in enumerate(parts) if len(codes) > 1]

    def codes(self, line: str | None) -> np.ndarray:
        words = line.split(" ") if line else []
        return np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))

    def found(self, flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of the term, count) of all terms in texts that stand behind one another, in the order of rows and terms."""
        at = np.flatnonzero(flat >= 0)
        codes = flat[at]
        nth = self.single[codes]
        rows, terms = [row[at][nth >= 0]], [nth[nth >= 0]]
        if self.phrases:
            order = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[order], np.arange(len(self.code) + 1))
            often = np.diff(ends)
            for term, phrase in self.phrases:
                rare = min(range(len(phrase)), key=lambda j: often[phrase[j]])
                start = at[order[ends[phrase[rare]] : ends[phrase[rare] + 1]]] - rare
                start = start[(start >= 0) & (start + len(phrase) <= len(flat))]
                start = start[row[start] == row[start + len(phrase) - 1]]
                for j, word in enumerate(phrase):
                    start = start[flat[start + j] == word]
                rows.append(row[start])
                terms.append(np.full(len(start), term))
        key, count = np.unique(np.concatenate(rows) * len(self.number) + np.concatenate(terms), return_counts=True)
        return key // max(1, len(self.number)), key % max(1, len(self.number)), count


def _finder(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Vocabulary(held.value)
        for batch in batches:
            done, lists, words = 0, [], 0
            for i, line in enumerate(batch.column(1)):
                lists.append(known.codes(line.as_py()))
                words += len(lists[-1])
                if words >= MOST_WORDS or i + 1 == batch.num_rows:
                    size = np.array([len(x) for x in lists])
                    row, term, count = known.found(np.concatenate(lists), np.repeat(np.arange(len(lists)), size))
                    ends = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(done, len(lists)), pa.array(size, pa.int32()),
                            pa.ListArray.from_arrays(ends, pa.array(known.number[term], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(count, pa.int32())),
                        ],
                        names=["id", "size", "numbers", "counts"],
                    )
                    done, lists, words = i + 1, [], 0

    return run


def numbered(terms: DataFrame) -> DataFrame:
    """(term, number): each distinct term once, written."""
    return written(terms.select("term").where("term is not null").distinct().withColumn("number", F.monotonically_increasing_id()))


def counted(rows: DataFrame, known: DataFrame, id_col: str, text: Column, most_terms: int = MOST_TERMS) -> DataFrame:
    """(id, size, numbers, counts, pass) of each row: the terms of ``known(term, number)`` that it holds and how often, phrases and overlaps included.

    Texts are cut into words once a pass; a pass looks for ``most_terms`` terms at most, and every pass has a record for every row.
    """
    line = F.array_join(T.words_of(text), " ")
    lines = rows.select(F.col(id_col).alias("id"), line.alias("line"))
    kind = rows.schema[id_col].dataType.simpleString()
    context, found = rows.sparkSession.sparkContext, None
    passes = max(1, -(-known.count() // most_terms))
    for k in range(passes):
        part = [(r.number, r.term) for r in known.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k).collect()]
        one = lines.mapInArrow(_finder(context.broadcast(part)), f"id {kind}, size int, numbers array<bigint>, counts array<int>").withColumn("pass", F.lit(k))
        found = one if found is None else found.union(one)
    return found


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of all lists, and the list that each belongs to."""
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))


def _block(docs: pa.Table, asked: pa.Table, k: int, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(place of the question, place of the id, score) of the best ``k`` of each question among the rows of one block, and the ids in order."""
    docs = docs.take(pc.sort_indices(docs["id"].combine_chunks(), null_placement="at_start"))
    ids = docs["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    of = ids.indices.to_numpy()
    number, row = _flat(docs["numbers"])
    tf, _ = _flat(docs["counts"])
    size, mean = docs["size"].to_numpy()[row], asked["mean"][0].as_py()
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
    # one entry for each term and id, in this order
    order = np.lexsort((of[row], number))
    number, at, part = number[order], of[row][order], part[order]
    first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (at[1:] != at[:-1])][: len(number)])
    number, at, part = number[first], at[first], np.add.reduceat(part, first) if len(first) else part
    terms, starts = np.unique(number, return_index=True)
    ends = np.r_[starts[1:], len(number)]
    wanted, of_question = _flat(asked["numbers"])
    weights, _ = _flat(asked["weights"])
    place = np.searchsorted(terms, wanted)
    there = np.flatnonzero((place < len(terms)) & (terms[np.minimum(place, len(terms) - 1)] == wanted)) if len(terms) else np.array([], np.int64)
    cut = np.searchsorted(of_question[there], np.arange(len(asked) + 1))
    score, out = np.zeros(len(ids.dictionary)), []
    for q in range(len(asked)):
        mine = there[cut[q] : cut[q + 1]]
        if not len(mine):
            continue
        for i in mine:
            s = slice(starts[place[i]], ends[place[i]])
            score[at[s]] += weights[i] * part[s]
        hit = np.flatnonzero(score)
        rounded = np.round(score[hit], 6)
        if len(hit) > k:
            least = np.partition(rounded, len(hit) - k)[len(hit) - k]
            some = np.flatnonzero(rounded >= least)
            some = some[np.argsort(-rounded[some], kind="stable")[:k]]
            hit, rounded = hit[some], rounded[some]
        out.append((np.full(len(hit), q), hit, rounded))
        score[:] = 0
    q, at, rounded = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.array([], np.int64), np.array([], np.int64), np.array([]))
    return q, at, rounded, ids.dictionary


def best_scores(held: DataFrame, asked: DataFrame, k: int, k1: float, b: float, most_rows: int = MOST_ROWS, most_asked: int = MOST_ASKED) -> DataFrame:
    """``held`` of :func:`counted` and ``asked(question, number, weight, mean)`` -> (question, id, score) with each block's best ``k`` of a question, ties by id.

    The score of a row is the sum of weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean)), to six digits. Rows are dealt to blocks by id, questions to
    parts, and every block meets every part in one task. The best ``k`` of all are among what comes back.
    """
    n, n_asked = (x.agg(F.count("*")).first()[0] for x in (held, asked))
    blocks = max(-(-n // most_rows), min(held.sparkSession.sparkContext.defaultParallelism, -(-n // 2048)), 1)
    parts = max(1, -(-n_asked // most_asked))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = held.where(F.size("numbers") > 0).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    packed = F.sort_array(F.collect_list(F.struct("number", "weight")))
    each = asked.groupBy("question").agg(packed.alias("x"), F.first("mean").alias("mean"))
    each = each.select("question", F.col("x.number").alias("numbers"), F.col("x.weight").alias("weights"), "mean")
    each = each.withColumn("part", F.pmod(F.xxhash64("question"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    out = StructType([asked.schema["question"], held.schema["id"]]).add("score", "double")

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not (len(docs) and len(asked)):
            return pa.table({"question": asked["question"].slice(0, 0), "id": docs["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        q, at, score, ids = _block(docs, asked, k, k1, b)
        return pa.table({"question": asked["question"].take(pa.array(q)), "id": ids.take(pa.array(at)), "score": pa.array(score, pa.float64())})

    return rows.groupBy("block", "part").cogroup(each.groupBy("block", "part")).applyInArrow(run, out)

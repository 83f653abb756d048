"""Substring dedup by hashing lines and the sentences within them.

Every line of ``line_words`` words and every sentence of ``sentence_words`` words is a unit.
Units are normalised (lower case, white space collapsed) and hashed to 128 bits; digests
are grouped over all documents with map-side combining, so a line that a third of all
documents carry reaches its group as one row a task; the occurrences are then joined to their group on the digest, where
adaptive execution splits a key of very many rows. The earliest occurrence (document order, then
offset) stays; every other one is removed from its document, with its span in characters
of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import in_order, materialize, release

#: a shorter line (a notice, a heading) is common to unrelated documents and is no repeated passage
LINE_WORDS, SENTENCE_WORDS = 13, 8
_SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+").finditer


def units(text: str, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised) of each unit; a line's span takes its line feed along."""
    at = 0
    for line in text.split("\n"):
        stop = at + len(line)
        words = line.lower().split()
        if len(words) >= line_words:
            yield at, min(stop + 1, len(text)), " ".join(words)
        if len(words) > sentence_words:
            for m in _SENTENCE(line):
                part = m.group().lower().split()
                if sentence_words <= len(part) < len(words):
                    yield at + m.start(), at + m.end(), " ".join(part)
        at = stop + 1


def _digests(line_words: int, sentence_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest as digest

        low = (1 << 64) - 1
        for batch in batches:
            us, starts, ends, d1, d2 = [], [], [], [], []

            def out() -> pa.RecordBatch:
                unsigned = lambda x: pa.array(x, pa.uint64()).view(pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pa.array(us, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), unsigned(d1), unsigned(d2)],  # noqa: B023
                    names=["u", "start", "end", "d1", "d2"],
                )

            for u, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for start, end, words in units(raw.as_py().decode(), line_words, sentence_words):
                    h = digest(words.encode())
                    us.append(u)
                    starts.append(start)
                    ends.append(end)
                    d1.append(h >> 64)
                    d2.append(h & low)
                if len(us) > 200_000:
                    yield out()
                    us, starts, ends, d1, d2 = [], [], [], [], []
            yield out()

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, sizes, spans = [], [], [], []
        for doc, raw, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            text, merged = raw.as_py().decode(), []
            for x in sorted((x["start"], x["end"]) for x in found.as_py() or []):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            edges = [0, *(e for span in merged for e in span), len(text)]
            ids.append(doc)
            sizes.append(len(text))
            spans.append(merged)
            texts.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
            names=["id", "text", "n_chars", "spans"],
        )


def unit_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS
) -> DataFrame:
    """One row per input row: id, text (what is left), n_chars (before), spans (removed [start, end), in characters).

    Null text is the empty text. Documents are ordered by id, null last, then by text; of repeated
    rows each is a document of its own, so the later one loses all its units. Other columns
    are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = in_order(docs, id_col, text_col)
    found = materialize(
        texts.select("u", "raw").mapInArrow(_digests(line_words, sentence_words), "u long, start int, end int, d1 long, d2 long"), "zstd"
    )
    place = F.struct("u", "start", "end")
    firsts = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(firsts, ["d1", "d2"]).where(place > F.col("first"))
    gone = materialize(later.groupBy("u").agg(F.collect_list(F.struct("start", "end")).alias("found")), "zstd")
    release(spark)
    out = texts.join(gone.hint("shuffle_hash"), "u", "left").select("id", "raw", "found")
    schema = "id long, text string, n_chars long, spans array<array<long>>"
    return out.mapInArrow(_cut_out, schema).withColumnRenamed("id", id_col)


def with_span_text(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The spans as text ("0-13,40-55") and what they add up to."""
    return found.select(
        id_col, "text", "n_chars",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string")))).alias("removed_spans"),
    )

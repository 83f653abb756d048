"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text in windows of ``WINDOW`` bytes, labels every byte with a
distribution over the languages, and a document's probabilities are the mean over all its bytes.
The last window of a text overlaps the one before, whose bytes are not counted twice. Only the
fit, on a bounded sample (``fit_docs`` documents for each language, ``fit_windows``
windows of each), runs on the driver; the fitted weights are a few kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, HIDDEN = 64, 8
NONE = "und"


def held_out(id_col: str) -> Column:
    """Documents that the fit never sees: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 4 == 2, F.lit(False))


# -- the network; arrays are (features, windows), so that every step is contiguous --


def new_weights(n_langs: int, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    w = {}
    for side in "fb":
        w[f"x{side}"] = draw.normal(0, 0.3, (256, 3 * hidden))
        w[f"u{side}"] = draw.normal(0, hidden**-0.5, (3 * hidden, hidden))
        w[f"v{side}"] = draw.normal(0, hidden**-0.5, (n_langs, hidden))
    w["c"] = np.zeros(n_langs)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _step(w: dict, side: str, byte: np.ndarray, h: np.ndarray):
    n = len(h)
    a = w[f"x{side}"][byte].T
    b = w[f"u{side}"] @ h
    gates = _sigmoid(a[: 2 * n] + b[: 2 * n])
    z, r = gates[:n], gates[n:]
    new = np.tanh(a[2 * n :] + r * b[2 * n :])
    return z, r, new, b[2 * n :], new + z * (h - new)


def label_bytes(w: dict, windows: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) bytes -> probabilities (WINDOW, languages, windows)."""
    n, steps = windows.shape
    columns = np.ascontiguousarray(windows.T)
    logits = np.empty((steps, len(w["c"]), n), np.float32)
    logits[:] = w["c"][:, None]
    for side, order in (("f", range(steps)), ("b", reversed(range(steps)))):
        h = np.zeros((w[f"u{side}"].shape[1], n), np.float32)
        for t in order:
            h = _step(w, side, columns[t], h)[-1]
            logits[t] += w[f"v{side}"] @ h
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def _gradients(w: dict, windows: np.ndarray, used: np.ndarray, lang: np.ndarray) -> dict:
    """Backpropagation through time of the mean cross-entropy over used bytes."""
    n, steps = windows.shape
    columns, on = np.ascontiguousarray(windows.T), used.T.astype(np.float32)
    kept, logits = {}, np.empty((steps, len(w["c"]), n), np.float32)
    logits[:] = w["c"][:, None]
    for side in "fb":
        h, kept[side] = np.zeros((w[f"u{side}"].shape[1], n), np.float32), {}
        for t in range(steps) if side == "f" else reversed(range(steps)):
            z, r, new, bn, after = _step(w, side, columns[t], h)
            kept[side][t] = (h, z, r, new, bn, after)
            h = after
            logits[t] += w[f"v{side}"] @ h
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    p[:, lang, np.arange(n)] -= 1
    p *= (on / on.sum())[:, None, :]
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["c"] = p.sum((0, 2))
    for side in "fb":
        size = w[f"u{side}"].shape[1]
        back = np.zeros((size, n), np.float32)
        for t in reversed(range(steps)) if side == "f" else range(steps):
            h, z, r, new, bn, after = kept[side][t]
            grad[f"v{side}"] += p[t] @ after.T
            back = back + w[f"v{side}"].T @ p[t]
            d_new = back * (1 - z) * (1 - new * new)
            d_z = back * (h - new) * z * (1 - z)
            d_r = d_new * bn * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_new])
            d_b = np.concatenate([d_z, d_r, d_new * r])
            np.add.at(grad[f"x{side}"], columns[t], d_a.T)
            grad[f"u{side}"] += d_b @ h.T
            back = back * z + w[f"u{side}"].T @ d_b
    return grad


def fit(windows: np.ndarray, used: np.ndarray, lang: np.ndarray, n_langs: int, epochs: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 5) -> dict:
    """Adam over shuffled minibatches; the same sample gives the same weights."""
    w, draw = new_weights(n_langs), np.random.default_rng(seed)
    first, second = ({x: np.zeros_like(v) for x, v in w.items()} for _ in range(2))
    k = 0
    for epoch in range(epochs):
        order = draw.permutation(len(windows))
        for part in np.array_split(order, -(-len(order) // batch)):
            grad, k = _gradients(w, windows[part], used[part], lang[part]), k + 1
            step = rate * (0.5 if epoch >= epochs // 2 else 1)
            for x in w:
                first[x] += 0.1 * (grad[x] - first[x])
                second[x] += 0.01 * (grad[x] ** 2 - second[x])
                w[x] -= step * (first[x] / (1 - 0.9**k)) / (np.sqrt(second[x] / (1 - 0.99**k)) + 1e-8)
    return w


# -- texts as windows --


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the bytes of each that count, and the text of each."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(x) for x in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = np.maximum(1, -(-size // WINDOW)) * (size > 0)
    of = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    start = np.maximum(0, np.minimum(nth * WINDOW, size[of] - WINDOW))
    at = start[:, None] + np.arange(WINDOW)
    inside = at < size[of][:, None]
    windows = np.where(inside, whole[np.where(inside, first[of][:, None] + at, 0)], 0)
    return windows, inside & (at >= (nth * WINDOW)[:, None]), of


def pooled(w: dict, texts: list[bytes], block: int = 4096) -> np.ndarray:
    """Mean byte probabilities (texts, languages) of whole texts; zero for an empty one."""
    windows, used, of = cut(texts)
    total = np.zeros((len(texts), len(w["c"])))
    for a in range(0, len(windows), block):
        part = slice(a, a + block)
        p = label_bytes(w, windows[part])
        np.add.at(total, of[part], np.einsum("tcn,nt->nc", p, used[part].astype(np.float32)))
    return total / np.maximum(1, [len(x) for x in texts])[:, None]


def sample_rows(rows: DataFrame, fit_docs: int) -> DataFrame:
    """At most ``fit_docs`` of ``rows(lang, h, ...)`` for each language, those of the smallest hashes.

    A language with many rows is thinned by its count before any of its rows are shuffled, to twice
    what is asked for; only what is left is ranked, so no task sees a whole language.
    """
    # one row for each language, as many as the network has outputs
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    thin = rows.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) / F.lit(2.0**30) * F.col("rows") <= 2 * fit_docs + 64).drop("rows")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    return thin.withColumn("nth", nth).where(F.col("nth") <= fit_docs).drop("nth")


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit_docs: int = 500, fit_windows: int = 4) -> tuple[list[str], dict] | None:
    """Languages and weights from a sample of the documents that are not held out."""
    spots = [
        F.expr(f"substring(text, 1 + cast(pmod(xxhash64(id, {k}), greatest(length(text) - {WINDOW // 2}, 1)) as int), {WINDOW})")
        for k in range(fit_windows)
    ]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("out"))
    usable = rows.where(f"not out and id is not null and lang is not null and lang <> '{NONE}' and text rlike '\\\\p{{L}}'")
    rows = (
        sample_rows(usable.withColumn("h", F.xxhash64("id", "text")), fit_docs)
        .select("lang", "h", "id", *(s.alias(f"w{k}") for k, s in enumerate(spots)))
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["h"], r["id"]))
    langs = sorted({r["lang"] for r in rows})
    texts, lang = [], []
    for i, r in enumerate(rows):
        for k in range(fit_windows):
            raw = r[f"w{k}"].encode("utf-8", "replace")[:WINDOW]
            # every fourth window is short, as short documents are
            texts.append(raw[: 8 + (i * 7 + k) % 40] if k % 4 == 3 else raw)
            lang.append(langs.index(r["lang"]))
    keep = [i for i, t in enumerate(texts) if t]
    windows, used, _ = cut([texts[i] for i in keep])
    return langs, fit(windows, used, np.array(lang)[keep], len(langs))


def _judged(model, raws: pa.Array, most: int = 1_000_000) -> Iterator[tuple[str, float]]:
    """(language, mean probability) of each text, a bounded number of bytes at a time."""
    langs, w = model
    group, size = [], 0
    for i, raw in enumerate(raws):
        group.append(raw.as_py() or b"")
        size += len(group[-1])
        if size > most or i + 1 == len(raws):
            p = pooled(w, group)
            best, score = p.argmax(1), p.max(1)
            yield from ((langs[k] if s > 0 else NONE, min(1.0, s)) for k, s in zip(best.tolist(), score.tolist(), strict=True))
            group, size = [], 0


def _labeller(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_judged(held.value, batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["id", "held_out", "lang_pred", "score"],
            )

    return run


def _raw(text: Column) -> Column:
    """The bytes of a text with letters, else null."""
    return F.when(text.rlike("\\p{L}"), F.encode(text, "utf-8"))


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (mean probability of that language).

    The fit uses text and non-null language of documents that are not held out; predictions use the
    text alone. A text that is null, empty or without letters is ``und`` with score 0, as is every
    text if there is nothing to learn from. A null id is not held out and not learned from;
    repeated rows each get a row; other columns are ignored; an empty table gives an empty table.
    """
    model = learn(docs, id_col, text_col, lang_col, **bounds)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), _raw(F.col(text_col).cast("string")).alias("raw"))
    if model is None:
        found = rows.select("id", "held_out", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)
        found = rows.mapInArrow(_labeller(held), "id long, held_out boolean, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def _sifter(held, wanted: tuple[str, ...] | None, least_lead: float, label: int):
    """Batches whose last column is the bytes of the text -> the other columns of the rows that stay, with the language found in the column ``label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = 1 / len(held.value[0])
        least_score = chance + least_lead * (1 - chance) if least_lead > 0 else 0.0
        for batch in batches:
            raws, rest = batch.column(batch.num_columns - 1), batch.columns[:-1]
            found = list(_judged(held.value, raws))
            stays = [lang != NONE and score >= least_score and (wanted is None or lang in wanted) for lang, score in found]
            rest[label] = pa.array([lang for lang, _ in found], pa.string()).cast(rest[label].type)
            yield pa.RecordBatch.from_arrays(rest, names=batch.schema.names[:-1]).filter(pa.array(stays, pa.bool_()))

    return run


def with_known_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    wanted: tuple[str, ...] | None = None, least_lead: float = 0.0, **bounds,
) -> DataFrame:
    """The rows of ``docs`` that the network places in a language, with all their columns, in one pass; ``lang_col`` holds that language.

    Each row is judged by its own text: it goes if the text is null or has no letters, or if ``wanted`` is given and the best language
    is not among it. A caller may ask for a best language that is ``least_lead`` of the way from chance to certainty; by
    default every text with letters has one. A label is never a reason to go; what was given is replaced by what the text shows, also where it was
    null. Repeated ids and rows are judged one by one. With nothing to learn from, rows with letters stay, with the label that they have. An empty table gives an empty table.
    """
    model = learn(docs, id_col, text_col, lang_col, **bounds)
    raw = _raw(F.col(text_col).cast("string"))
    if model is None:
        return docs.where(raw.isNotNull())
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("*", raw.alias("__raw")).mapInArrow(_sifter(held, wanted, least_lead, docs.columns.index(lang_col)), docs.schema)

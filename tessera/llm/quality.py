"""Quality classifier by co-training: one view of a page's words, one of its metadata.

The content view sees which words and which token shapes (capitals, digits, marks) a text holds;
the metadata view sees source, language, size and layout figures. Each view is a logistic
regression fitted in numpy. In every round each view labels the documents of an unlabelled
pool of which it is surest, as many of each class as their shares ask for, and hands them to the other view.
Views are then calibrated (Platt) on labelled documents that the fit did not see, and their log-odds
add up. The fit sees ``fit_rows`` labelled and ``pool_rows`` unlabelled documents at most;
every document is scored on its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, SHAPES, META = 1 << 20, 1 << 10, 1 << 10
_RUNS = [(re.compile(p), r) for p, r in ((r"[^\W\d_a-z]*[A-Z][^\W\d_a-z]*", "A"), (r"[^\W\dA_]+", "a"), (r"\d+", "0"))]
_BARE = re.compile(r"[\W\d_]+")
#: class of each character below 2^16: bits for upper case, letter, digit, white space
_CLASS = np.array([c.isupper() | c.isalpha() << 1 | c.isdigit() << 2 | c.isspace() << 3 for c in map(chr, range(1 << 16))], np.uint8)
_known: dict[str, tuple[int, ...]] = {}


def _token(token: str) -> tuple[int, ...]:
    """Buckets of a token's word, its first letters and its shape."""
    found = _known.get(token)
    if found is None:
        shape = token
        for pattern, mark in _RUNS:
            shape = pattern.sub(mark, shape)
        word = _BARE.sub("", token).lower()
        found = crc32(word.encode()) % WORDS, crc32(b"^" + word[:5].encode()) % WORDS, WORDS + crc32(shape.encode()) % SHAPES
        if len(_known) < 500_000:
            _known[token] = found
    return found


def char_counts(text: str) -> list[int]:
    """Upper-case characters, letters, digits and white space; characters beyond the table are none of them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.bincount(_CLASS[codes[codes < len(_CLASS)]], minlength=16)
    return [int(seen[(np.arange(16) & bit) > 0].sum()) for bit in (1, 2, 4, 8)]


def features(text: str, meta: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(content, metadata): sorted bucket numbers of one document."""
    tokens = text.split()
    distinct = set(tokens)
    content = {i for t in distinct for i in _token(t)}
    n, lines = max(1, len(text)), text.count("\n") + 1
    tenth = lambda part, whole: min(10, int(10 * part / max(1, whole)))
    upper, alpha, digit, space = char_counts(text)
    facts = [*meta, n.bit_length(), lines.bit_length(), (n // lines).bit_length(), tenth(upper, alpha), tenth(digit, n),
             tenth(4 * (n - alpha - digit - space), n), tenth(len(distinct), len(tokens)), tenth(2 * space, n)]
    return np.array(sorted(content), np.int32), np.array(sorted({crc32(f"{i}={x}".encode()) % META for i, x in enumerate(facts)}), np.int32)


def _featured(scorer=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer and scorer.value
        for batch in batches:
            ids, metas = batch.column(0), batch.column(2).to_pylist()
            views = (features(t.as_py() or "", m) for t, m in zip(batch.column(1), metas, strict=True))
            if score is None:
                a, b = zip(*((x.tobytes(), y.tobytes()) for x, y in views), strict=True) if batch.num_rows else ((), ())
                yield pa.RecordBatch.from_arrays([ids, pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["id", "content", "meta"])
            else:
                rows = np.array([score(x, y) for x, y in views]).reshape(batch.num_rows, len(score.heads))
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(rows), pa.list_(pa.float64()))], names=["id", "scores"])

    return run


class View:
    """Logistic regression over sets of buckets, each scaled by the log-ratio of its shares in the two classes.

    Buckets of fewer than ``least`` rows weigh nothing.
    """

    def __init__(self, size: int, rounds: int = 150, rate: float = 0.05, decay: float = 1e-3, least: int = 6):
        self.weights, self.bias = np.zeros(size, np.float32), 0.0
        self.rounds, self.rate, self.decay, self.least = rounds, rate, decay, least

    def raw(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() + self.bias)

    def raws(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.raw(x) for x in rows])

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> View:
        flat, sizes = np.concatenate(rows), np.array([len(x) for x in rows])
        of = np.repeat(np.arange(len(rows)), sizes)
        names, at, often = np.unique(flat, return_inverse=True, return_counts=True)
        enough = often >= self.least
        names, at, of = names[enough], (np.cumsum(enough) - 1)[at[enough[at]]], of[enough[at]]
        ups = np.bincount(at, y[of], len(names))
        ratio = np.log((ups + 0.5) / (y.sum() + 1)) - np.log((often[enough] - ups + 0.5) / ((~y).sum() + 1))
        value = ratio[at]
        share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))  # classes weigh the same
        weights, bias, seen, seen_bias = np.zeros(len(names)), 0.0, np.full(len(names), 1e-10), 1e-10
        for _ in range(self.rounds):
            z = np.bincount(of, weights[at] * value, len(rows)) + bias
            error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            grad = np.bincount(at, error[of] * value, len(names)) + self.decay * weights
            seen += grad**2
            seen_bias += error.sum() ** 2
            weights -= self.rate * grad / seen**0.5
            bias -= self.rate * error.sum() / seen_bias**0.5
        self.weights[:], self.bias = 0, float(bias)
        self.weights[names] = weights * ratio
        return self


def platt(raw: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn raw scores into log-odds (Newton steps on smoothed labels)."""
    a, b = 0.0, float(np.log((y.sum() + 1) / ((~y).sum() + 1)))
    aim = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g, w = p - aim, p * (1 - p) + 1e-6
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(g * raw).sum() + 1e-3 * a, g.sum()]))
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(float(a), 0.0), float(b)


class Head:
    """Both views of one target after co-training, calibrated."""

    def __init__(self, rows: tuple[list, list], y: np.ndarray, pool: tuple[list, list], rounds: int, grow: int):
        test = np.arange(len(y)) % 5 == 0
        known = [[x for x, t in zip(view, test, strict=True) if not t] for view in rows]
        labels = [y[~test].copy(), y[~test].copy()]
        self.views = [View(WORDS + SHAPES), View(META)]
        left, share = np.arange(len(pool[0])), y.mean()
        fit = lambda k: self.views[k].fit(known[k], labels[k])
        fit(0), fit(1)
        for _ in range(rounds):
            taken: set[int] = set()
            for k in (0, 1):
                raw = self.views[k].raws([pool[k][i] for i in left])
                order, up = np.argsort(raw, kind="stable"), max(1, round(grow * share))
                sure = [(i, False) for i in order[: max(1, grow - up)] if raw[i] < -1] + [(i, True) for i in order[::-1][:up] if raw[i] > 1]
                known[1 - k] = known[1 - k] + [pool[1 - k][left[i]] for i, _ in sure]
                labels[1 - k] = np.concatenate([labels[1 - k], np.array([v for _, v in sure], bool)])
                taken |= {int(i) for i, _ in sure}
            if not taken:
                break
            left = np.delete(left, sorted(taken))
            fit(0), fit(1)
        self.prior = float(np.log((y.sum() + 1) / ((~y).sum() + 1)))
        self.scale = [platt(v.raws([x for x, t in zip(r, test, strict=True) if t]), y[test]) for v, r in zip(self.views, rows, strict=True)]

    def score(self, content: np.ndarray, meta: np.ndarray) -> float:
        odds = -self.prior
        for view, (a, b), x in zip(self.views, self.scale, (content, meta), strict=True):
            odds += a * view.raw(x) + b
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


class Scorer:
    def __init__(self, heads: list[Head | None]):
        self.heads = heads

    def __call__(self, content: np.ndarray, meta: np.ndarray) -> list[float | None]:
        return [float("nan") if h is None else h.score(content, meta) for h in self.heads]


def _rows(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...]) -> DataFrame:
    metas = F.array(*(F.col(c).cast("string") for c in meta_cols if c in docs.columns), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), metas.alias("meta"))


def learn(rows: DataFrame, labels: DataFrame, id_col: str, targets: tuple[str, ...], fit_rows: int, pool_rows: int, rounds: int, grow: int) -> Scorer:
    marks = (
        labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(*(F.max(F.col(t).cast("int")).alias(f"y{k}") for k, t in enumerate(targets)))
    )
    marked = marks.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    ids = rows.where("id is not null").select("id").distinct()
    free = ids.join(marks, "id", "left_anti").orderBy(F.xxhash64("id"), "id").limit(pool_rows)
    drawn = marked.unionByName(free, allowMissingColumns=True)
    # at most fit_rows + pool_rows ids, so the broadcast has a fixed bound
    # an id that repeats is learned from once, by its least text hash
    least = F.min_by(F.struct("text", "meta"), F.xxhash64("text", "meta")).alias("row")
    single = rows.join(F.broadcast(drawn.select("id")), "id").groupBy("id").agg(least).select("id", "row.*")
    seen = single.mapInArrow(_featured(), "id long, content binary, meta binary")
    y = {r["id"]: r for r in marked.collect()}
    found = sorted(seen.collect(), key=lambda r: (r["id"], r["content"]))
    array = lambda b: np.frombuffer(b, np.int32)
    pool = [(array(r["content"]), array(r["meta"])) for r in found if r["id"] not in y]
    heads: list[Head | None] = []
    for k in range(len(targets)):
        own = [(array(r["content"]), array(r["meta"]), y[r["id"]][f"y{k}"] > 0) for r in found if r["id"] in y and y[r["id"]][f"y{k}"] is not None]
        own = [own[i] for i in np.random.default_rng(11).permutation(len(own))]
        truth = np.array([x[2] for x in own], bool)
        if truth.sum() < 5 or (~truth).sum() < 5:
            heads.append(None)
        else:
            heads.append(Head(([x[0] for x in own], [x[1] for x in own]), truth, ([x[0] for x in pool], [x[1] for x in pool]), rounds, grow))
    return Scorer(heads)


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"),
    targets: tuple[str, ...] = ("quality", "toxic"), fit_rows: int = 5000, pool_rows: int = 3000, rounds: int = 3, grow: int = 300,
) -> DataFrame:
    """One row per document: id and, for each target, ``<target>_score``, the probability of label 1.

    Null text is empty text; a null id is scored and not learned from; labels of one id are joined by
    their maximum, null labels are none; labels without document are ignored. A target with fewer than five
    labels of either class has null scores. Repeated rows each get a row, other columns are ignored, and
    an empty table gives an empty table.
    """
    rows = _rows(docs, id_col, text_col, meta_cols)
    held = docs.sparkSession.sparkContext.broadcast(learn(rows, labels, id_col, targets, fit_rows, pool_rows, rounds, grow))
    found = rows.mapInArrow(_featured(held), "id long, scores array<double>")
    return found.select(F.col("id").alias(id_col), *(F.nanvl(F.col("scores")[k], F.lit(None)).alias(f"{t}_score") for k, t in enumerate(targets)))


def with_verdict(scored: DataFrame) -> DataFrame:
    """``kept``: of good quality and not toxic; what could not be scored stays."""
    good = F.coalesce(F.col("quality_score") >= 0.5, F.lit(True)) & F.coalesce(F.col("toxic_score") < 0.5, F.lit(True))
    return scored.withColumn("kept", good)

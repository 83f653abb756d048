"""Rules that hold at sizes no test table has, recall of the vector search, and special strings."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import ids_of
from test_suffix_dedup import brute, rows_of, sample

from tessera.llm.embedding_dedup import embedding_components
from tessera.llm.language_id import _gradients, cut, label_bytes, new_weights, pooled
from tessera.llm.mixing import GOLDEN, mix, mixed_documents, point, running
from tessera.llm.packing import pack
from tessera.llm.quality import char_counts, platt
from tessera.llm.queries import tokenizer_file
from tessera.llm.suffix_dedup import doubling_steps, repeated_spans
from tessera.llm.token_store import Shard, read_shards, write_shards


def test_points_of_late_slots(spark):
    slots = [0, 1, 2**32, 10**10, 3_475_000_000, 2**40 + 7, 2**61 + 5]
    df = spark.createDataFrame([(s,) for s in slots], "slot long")
    assert [r[0] for r in df.select(point(F.col("slot"))).collect()] == [s * GOLDEN % 2**62 for s in slots]
    assert abs(GOLDEN / 2**62 - (5**0.5 - 1) / 2) < 1e-15 and GOLDEN % 2


def test_running_sums_in_two_levels(spark):
    rows = [(f"s{i * 7919 % 1000:03d}" if i else None, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "source string, n long").repartition(7)
    want, before = {}, 0
    for k, (s, n) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))):
        want[s] = (k, before)
        before += n
    assert {r.source: (r.nth, r.n_before) for r in running(df, [F.col("source").isNull(), F.col("source")], "n").collect()} == want


def test_mix_of_many_sources_repeats_and_order(spark):
    rows = [(i % 50, " ".join(["w"] * (3 + i % 9)), f"d{i % 300}") for i in range(900)] + [(1, "w w w", "d1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    fine, coarse = (mix(df, block_words=w).groupBy("source_size", "target").agg(F.sum("taken")).collect() for w in (4, 1024))
    assert sorted(fine) == sorted(coarse) and mix(df).count() == len(rows)
    total = sum(len(t.split()) for _, t, _ in rows)
    got = mixed_documents(df.withColumn("u", F.lit(1)).withColumn("slot", F.lit(2)), block_words=16)
    assert got.columns == ["doc_id", "text", "source", "u", "slot"]
    texts = [r.text for r in got.collect()]
    assert abs(sum(len(t.split()) for t in texts) - total) < 0.1 * total
    # sources take turns all along the mix
    order = [r.source for r in got.collect()]
    assert len(set(order[: len(order) // 4])) > 60
    assert mixed_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [64, 12])
def test_recall_on_a_dense_group_of_many_cells(spark, dim):
    draw = np.random.default_rng(9)
    base = draw.normal(size=(40, dim))
    dense = draw.normal(size=dim)
    rows = [dense + draw.normal(size=dim) * 0.23 for _ in range(1500)]
    rows += [base[i % 40] + draw.normal(size=dim) * 0.2 for i in range(1500)] + list(draw.normal(size=(1500, dim)))
    unit = np.array(rows, "f4").astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    found = embedding_components(df, probes=4).collect()
    links = np.zeros(len(rows), int)
    for r in found:
        links[r.vec_id] = r.n_links
    assert true.sum() > 2000 and (links <= true).all()
    assert links.sum() >= 0.98 * true.sum()
    if dim == 12:  # the border rule covers a link's whole length here
        assert (links == true).all()


def test_gradients_by_differences():
    draw = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in new_weights(3, hidden=4).items()}
    windows, used, _ = cut([bytes(draw.integers(97, 105, n).tolist()) for n in (9, 64, 30, 5)])
    lang = np.array([0, 1, 2, 1])

    def loss(v):
        p = label_bytes({k: x.astype(np.float32) for k, x in v.items()}, windows)
        mine = np.log(p[:, lang, np.arange(len(lang))])
        return -(mine * used.T).sum() / used.sum()

    grad = _gradients({k: v.astype(np.float32) for k, v in w.items()}, windows, used, lang)
    for k in w:
        spots = [tuple(draw.integers(0, n) for n in w[k].shape) for _ in range(4)]
        spots += [(98, *s[1:]) for s in spots] if k.startswith("x") else []
        for s in spots:
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][s] += 0.02
            down[k][s] -= 0.02
            assert grad[k][s] == pytest.approx((loss(up) - loss(down)) / 0.04, abs=2e-3)


def test_pooled_is_the_mean_over_bytes():
    w = new_weights(3)
    texts = [b"abcabc" * 30, b"", b"xyz", b"q" * 64, b"hello " * 11]
    for text, got in zip(texts, pooled(w, texts, block=2), strict=True):
        total = np.zeros(3)
        for at in range(0, len(text), 64):
            start = max(0, min(at, len(text) - 64))
            window = np.zeros((1, 64), np.uint8)
            part = np.frombuffer(text[start : start + 64], np.uint8)
            window[0, : len(part)] = part
            p = label_bytes(w, window)[:, :, 0]
            total += p[at - start : min(64, len(text) - start)].sum(0)
        assert got == pytest.approx(total / max(1, len(text)), abs=1e-5)


def test_special_strings_as_the_library_has_them(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|EndOfText|>x", "tail <|startoftext|>", "<| endoftext |>", "plain text", None, "x" * 20_000]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(2, "again"), (2, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = pack(df.where("doc_id is null or doc_id <> 2"), tokenizer_file("word_bpe_49k.json")).collect()
    for i, t in enumerate(texts):
        own = sorted((p.start, p.ids) for p in pieces if p.doc_id == (i if i != 4 else None))
        assert i == 2 or b"".join(x for _, x in own) == ids_of("word_bpe_49k.json", t, 1).tobytes()
    assert pack(df.limit(0), tokenizer_file("word_bpe_49k.json")).count() == 0
    manifest = write_shards(df, f"file://{tmp_path}/ids", tokenizer_file("byte_bpe_50k.json"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in read_shards(manifest).collect())
    want = [(str(i), len(x), zlib.crc32(x.tobytes())) for i, x in ((i, ids_of("byte_bpe_50k.json", t, 0)) for i, t in rows)]
    assert got == sorted(want)
    for r in manifest.collect():
        path = r.path.removeprefix("file://")
        shard = Shard(open(f"{path}.ids", "rb").read(), open(f"{path}.mph", "rb").read())
        assert shard.get(987654321) is None and shard.get(2, occurrence=9) is None


def test_doubling_from_short_seeds(spark):
    assert doubling_steps(100, 25) == ([50], [0, 50]) and doubling_steps(37, 5) == ([10, 17], [0, 10, 17, 27])
    docs = [(i, t) for i, t in enumerate(sample(5, 60))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute([(i, t.encode()) for i, t in docs], 37)
    assert rows_of(repeated_spans(df, length=37, seed=5)) == want


def test_calibration_by_search():
    draw = np.random.default_rng(4)
    raw = draw.normal(size=300)
    y = draw.random(300) < 1 / (1 + np.exp(-(1.7 * raw - 0.6)))
    aim = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    loss = lambda a, b: -(aim * -np.logaddexp(0, -(a * raw + b)) + (1 - aim) * -np.logaddexp(0, a * raw + b)).sum()
    a, b = platt(raw, y)
    best = min((loss(p, q), p, q) for p in np.linspace(0, 4, 161) for q in np.linspace(-2, 2, 161))
    assert abs(a - best[1]) < 0.05 and abs(b - best[2]) < 0.05
    for text in ("", "Ab 1\t", "ÄÖ ß٣ x", "😀 A"):
        assert char_counts(text) == [sum(map(f, text)) for f in (str.isupper, str.isalpha, str.isdigit, str.isspace)]


def test_small_tables_use_cells_too(spark, monkeypatch):
    from tessera.llm import embedding_dedup as module

    fitted, fit = [], module.fit_centroids
    monkeypatch.setattr(module, "fit_centroids", lambda sample, k, **more: fitted.append(k) or fit(sample, k, **more))
    draw = np.random.default_rng(4)
    base = draw.normal(size=(120, 64))
    rows = [*base, *(base[i % 60] + draw.normal(size=64) * 0.2 for i in range(380))]
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 2) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    unit = np.array(rows, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    same = np.arange(500)[:, None] % 2 == np.arange(500)[None, :] % 2
    want = ((unit @ unit.T >= 0.93) & same & ~np.eye(500, dtype=bool)).sum(1)
    got = {r.vec_id: r.n_links for r in embedding_components(df).collect()}
    assert fitted == [11] and want.sum() > 500 and [got[i] for i in range(500)] == want.tolist()


def test_visits_in_waves_and_tiles_take_little_disk(spark, monkeypatch):
    """What visits write grew with the cells of a vector, 30 times the vectors' bytes here; now every pair is still found in waves and small tiles."""
    from pathlib import Path

    from tessera.llm import embedding_dedup as module

    alive, keep, drop = {}, module.materialize, module.discard
    most = [0]

    def kept(df, *how):
        out = keep(df, *how)
        alive[out._tessera_path] = sum(f.stat().st_size for f in Path(out._tessera_path.removeprefix("file://")).rglob("*") if f.is_file())
        most[0] = max(most[0], sum(alive.values()))
        return out

    def dropped(df):
        alive.pop(getattr(df, "_tessera_path", None), None)
        drop(df)

    monkeypatch.setattr(module, "materialize", kept)
    monkeypatch.setattr(module, "discard", dropped)
    draw = np.random.default_rng(14)
    rows = draw.normal(size=(3000, 64))
    rows[:600] = rows[600:1200] + draw.normal(size=(600, 64)) * 0.2
    rows[1200:1500] = rows[1200] + draw.normal(size=(300, 64)) * 0.25
    unit = np.array(rows, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.arange(3000) // 1500 % 2
    want = ((unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(3000, dtype=bool)).sum(1)
    df = spark.createDataFrame([(i, [float(x) for x in v], int(label[i])) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_components(df, tile=40, wave_bytes=3_000_000).collect()}
    assert want.sum() > 10_000 and [got[i] for i in range(3000)] == want.tolist()
    assert most[0] < 4 * 3000 * 64 * 4

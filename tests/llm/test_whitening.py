"""Whitening against numpy and exact integers."""

import math

import numpy as np
import pytest

from tessera.llm.whitening import Fit, _exact_sum, whiten


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    made = [(i, [float(v) for v in rng.normal(size=20)]) for i in range(300)]
    made += [(i + 1000, made[0][1]) for i in range(150)] + [(3, made[7][1]), (None, made[1][1])]
    bad = [None, [1.0, None] + [0.0] * 18, [math.nan] * 20, [math.inf] * 20, [-math.inf] + [0.0] * 19, []]
    return made, [(2000 + i, v) for i, v in enumerate(bad)] + [(2100, [1.0, 2.0]), (2101, [1.0, 2.0])]


def test_equals_numpy(spark, rows):
    made, odd = rows
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in made + odd], "vec_id long, embedding array<float>, n int, component string").repartition(5)
    got = whiten(df).collect()
    vectors = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000) for i, v in made]
    x = np.array(sorted({tuple(v) for _, v in vectors}))
    n, sums = len(x), x.sum(0)
    cov = (x - sums / n).T @ (x - sums / n) / n
    values, basis = (v[..., ::-1] for v in np.linalg.eigh(cov))
    full = [r for r in got if r.vec_id not in (2100, 2101)]
    assert len(full) == 16 * len(made) and {r.n for r in full} == {n} and max(r.identity_error for r in full) < 1e-9
    at = {}
    for r in full:
        at.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    signs = set()
    for i, v in vectors:
        deviation = int(((n * v - sums) ** 2).sum())
        mine = at[i, deviation]
        for k in range(16):
            want = float((v - sums / n) @ basis[:, k] / math.sqrt(values[k]))
            assert abs(abs(mine[k + 1].whitened) - abs(want)) < 1e-8 and mine[k + 1].deviation_digits == str(deviation)
            assert abs(mine[k + 1].explained / (values[k] / values.sum()) - 1) < 1e-9
            if abs(want) > 1e-6:
                signs.add((k, mine[k + 1].whitened * want > 0))
    assert len(signs) == 16
    flat = [r for r in got if r.vec_id in (2100, 2101)]
    assert len(flat) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in flat)
    assert whiten(df.limit(0)).count() == 0


def test_constant_dimension_and_huge_entries(spark):
    data = [(i, [float(i % 3), 1.0, 3e38 if i == 4 else float(i)]) for i in range(9)]
    got = whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 27 and all(r.whitened is None for r in got if r.component == 3)
    assert all(r.deviation is None and int(r.deviation_digits) > 1 << 63 for r in got if r.vec_id == 4)


def test_exact_sums_and_deviations():
    x = np.array([[1 << 62, -5], [1 << 62, 7], [1 << 62, -(1 << 61)]])
    total = _exact_sum(x)
    assert total.tolist() == [3 << 62, 2 - (1 << 61)]
    f = Fit(3, total)
    assert f.deviation(x) == [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]

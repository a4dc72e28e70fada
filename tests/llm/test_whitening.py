"""Whitening against one covariance of the whole fit list."""

import math

import numpy as np
import pytest

from tallyloom.llm import registry, whitening

SMALL = "/root/testdata/sf0.001"
TYPE = "vec_id long, embedding array<double>, n int, x string"


def brute(rows):
    """n, {vec_id: [(deviation, whitened up to sign)]}, explained, by numpy's eigenvectors of the covariance."""
    use = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in use}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = [(i, sum((n * a - int(t)) ** 2 for a, t in zip(x, total, strict=True)), [(np.array(x) - total / n) @ vectors[:, k] / math.sqrt(values[k]) for k in range(min(4, len(x)))]) for i, x in use]
    return n, out, values / values.sum()


def compare(got, rows):
    n, want, explained = brute(rows)
    k = min(4, len(rows[0][1]))
    assert len(got) == k * len(want) and {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    key = lambda i: (i is None, i or 0)
    want.sort(key=lambda w: (key(w[0]), w[1]))
    got = sorted(got, key=lambda r: (r.component, key(r.vec_id), r.deviation))
    for c in range(k):
        own = got[c * len(want) : (c + 1) * len(want)]
        a, b = np.array([r.whitened for r in own]), np.array([w[2][c] for w in want])
        assert np.abs(a - b * np.sign(a @ b)).max() < 1e-6 and abs(own[0].explained / explained[c] - 1) < 1e-9
        assert [(r.vec_id, int(r.deviation)) for r in own] == [(w[0], w[1]) for w in want]


@pytest.mark.parametrize("rows, fan_in", [(4096, 16), (7, 2)])
def test_table_against_one_covariance(spark, monkeypatch, rows, fan_in):
    monkeypatch.setattr(whitening, "ROWS", rows)
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = whitening.whiten(table.repartition(9)).collect()
    compare(got, [(r.vec_id, [float(c) for c in r.embedding]) for r in table.collect()])
    assert len(registry.QUERIES["op13_whitening"](spark, SMALL).collect()) == len(got)


def test_states_merge_in_any_grouping():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (500, 12))
    whole = whitening.state_of(x)
    parts = [whitening.state_of(p) for p in np.array_split(x, [1, 3, 8, 200])]
    left, right = parts[0], parts[-1]
    for p in parts[1:]:
        left = whitening.merged(left, p)
    for p in parts[-2::-1]:
        right = whitening.merged(p, right)
    for s in (left, right):
        assert s.n == 500 and s.total == whole.total and np.allclose(s.factor.T @ s.factor, whole.factor.T @ whole.factor, rtol=0, atol=1e-12 * np.abs(whole.factor).max() ** 2)
        assert np.allclose(np.linalg.svd(s.factor)[1], np.linalg.svd(whole.factor)[1], rtol=1e-12)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=6).round(3).tolist()) for i in range(40)]
    good += [(None, good[0][1]), (7, good[1][1]), (7, good[1][1]), (None, [-0.0, 0.0, 40.0, -40.0, 0.25, 0.5])]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (53, [float("nan")] * 6), (54, [float("inf"), *[0.0] * 5]), (55, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], TYPE)
    compare(whitening.whiten(df).collect(), good)
    assert whitening.whiten(df.filter("false")).collect() == [] and whitening.whiten(df.filter("vec_id BETWEEN 50 AND 54")).collect() == []
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e15])], "vec_id long, embedding array<double>")).collect()


def test_components_without_variance(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    one = make([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one if r.vec_id == 1] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)]
    two = make([(1, [1.0, 2.0]), (2, [3.0, 2.0])])
    assert {(r.component, r.whitened is None) for r in two} == {(1, False), (2, True)}
    assert all(abs(r.explained - 1) < 1e-12 and abs(abs(r.whitened) - 1) < 1e-12 and r.identity_error < 1e-12 for r in two if r.component == 1)


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float(i * 3_000_000_000), 1.0 * (i % 7)]) for i in range(1000)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, want, _ = brute(rows)
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, d) for i, d, _ in want} and max(d for _, d, _ in want) > 1 << 63

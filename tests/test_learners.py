"""Fits from sums against plain numpy on whole training sets, through the same folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import learners
from tallyloom.operators.learners import Design

DESIGN, SEED = Design(3, 2), 9
COSTS = [0.03, 3.0, 30.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n, d = 320, 4
    group = rng.integers(0, 14, n)
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 1] + group[:, None] * [0.1, 0, 0, 0]
    x[:, 3] = 2.5
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n) > 1.2).astype(int)
    rows = [(i, int(g), int(g) % 3, int(t), *map(float, v)) for i, (g, t, v) in enumerate(zip(group, y, x, strict=True))]
    df = spark.createDataFrame([*rows, (900, 1, 1, None, *[0.0] * 4), (901, 1, None, 1, *[0.0] * 4), (902, None, 1, 1, *[0.0] * 4), (903, 1, 1, 1, None, 0.0, 0.0, 0.0)], "id long, g int, fold int, y int, a double, b double, c double, d double")
    p = learners.prepared(df.repartition(4), "id", "g", "y", "fold", [F.col(c) for c in "abcd"], DESIGN, SEED)
    got = p.orderBy("id").collect()
    return p, learners.scales(p, DESIGN), {"id": [r.id for r in got], "x": np.array([r.x for r in got]), "y": np.array([r.y for r in got]), "fold": np.array([r.fold for r in got]), "held": np.array([r.held for r in got]), "g": group}


def sets(v):
    for o, i in DESIGN.sets():
        yield DESIGN.at(o, i), (v["fold"] != o) & ((i == DESIGN.inner) | (v["held"][:, o] != i))


def scaled(v, on):
    q = np.percentile(v["x"][on], [25, 50, 75], axis=0, method="inverted_cdf")
    keep = v["x"][on].var(axis=0) > 0
    return ((v["x"] - q[1]) / np.where(q[2] == q[0], 1, q[2] - q[0])) * keep, keep


def precision(y, s):
    out, order = 0.0, np.unique(s)[::-1]
    for c in order:
        at = s >= c
        out += (y[s == c] == 1).sum() * (y[at] == 1).sum() / at.sum()
    return out / max((y == 1).sum(), 1)


def choose(v, predict, grid):
    """Out-of-fold scores by plain loops."""
    out = np.full(len(v["y"]), np.nan)
    for o in range(DESIGN.outer):
        ap = [np.mean([precision(v["y"][on], predict(DESIGN.at(o, i), c)[on]) for i in range(DESIGN.inner) if (on := (v["fold"] != o) & (v["held"][:, o] == i)).any() and v["y"][on].any()]) for c in range(grid)]
        c = min(range(grid), key=lambda c: (-round(ap[c], 12), c))
        out[v["fold"] == o] = predict(DESIGN.at(o, DESIGN.inner), c)[v["fold"] == o]
    return out


def oof(p, fitted):
    r = learners.nested_cv(p, DESIGN, fitted).orderBy("id").collect()
    return np.array([x.score for x in r])


def test_rows_and_folds(data):
    p, s, v = data
    assert v["id"] == list(range(320)) and learners.straddling(p.withColumn("g", F.col("held").cast("string")), "g", "held").count() == 0
    for o in range(3):
        assert all(len({int(h) for h, g in zip(v["held"][:, o], v["g"], strict=True) if g == k}) == 1 for k in set(v["g"]))
    for t, on in sets(v):
        assert np.allclose(s.scaled(t, v["x"]), scaled(v, on)[0]) and s.keep[t].tolist() == [1, 1, 1, 0]


def test_logistic_against_newton(data):
    p, s, v = data
    fitted = learners.fit_logistic(p, DESIGN, s, COSTS)
    want = {}
    for t, on in sets(v):
        x = np.column_stack([scaled(v, on)[0], np.ones(len(v["y"]))])
        y = v["y"]
        a = np.where(y == 1, on.sum() / (2 * y[on].sum()), on.sum() / (2 * (1 - y[on]).sum()))
        for c, cost in enumerate(COSTS):
            w = np.zeros(x.shape[1])
            for _ in range(200):
                q = 1 / (1 + np.exp(-x[on] @ w))
                g = w + cost * x[on].T @ (a[on] * (q - y[on]))
                h = np.eye(len(w)) + cost * x[on].T @ (x[on] * (a[on] * q * (1 - q))[:, None])
                w -= np.linalg.solve(h, g)
            assert np.abs(g).max() < 1e-8
            want[t, c] = 1 / (1 + np.exp(-x @ w))
    assert all(np.abs(fitted.predict(t, c, v["x"]) - q).max() < 1e-6 for (t, c), q in want.items())
    got = oof(p, fitted)
    assert np.abs(got - choose(v, lambda t, c: want[t, c], len(COSTS))).max() < 1e-6 and not np.isnan(got).any()


def test_kernel_against_one_solve(data):
    p, s, v = data
    gammas = ["scale", 0.03]
    fitted = learners.fit_kernel(p, DESIGN, s, COSTS, gammas, 40, 5)
    rng = np.random.default_rng(5)
    way, phase, want = rng.normal(size=(4, 40)), rng.uniform(0, 2 * np.pi, 40), {}
    for t, on in sets(v):
        x, keep = scaled(v, on)
        y, a = 2 * v["y"] - 1, np.where(v["y"] == 1, on.sum() / (2 * v["y"][on].sum()), on.sum() / (2 * (1 - v["y"][on]).sum()))
        for g, gamma in enumerate([1 / (keep.sum() * x[on][:, keep].var()), 0.03]):
            z = np.column_stack([np.sqrt(2 / 40) * np.cos(np.sqrt(2 * gamma) * x @ way + phase), np.ones(len(y))])
            for c, cost in enumerate(COSTS):
                w = np.linalg.lstsq(np.vstack([z[on] * np.sqrt(a[on])[:, None], np.eye(41) / np.sqrt(cost)]), np.concatenate([y[on] * np.sqrt(a[on]), np.zeros(41)]), rcond=None)[0]
                want[t, g * len(COSTS) + c] = 1 / (1 + np.exp(-2 * z @ w))
    assert all(np.abs(fitted.predict(t, c, v["x"]) - q).max() < 1e-6 for (t, c), q in want.items())
    assert np.abs(oof(p, fitted) - choose(v, lambda t, c: want[t, c], 6)).max() < 1e-6


def tree(x, y, a, n, edges, depth, least):
    """One tree over all features by search; share of class 1 for any row."""
    share = (a * n)[y == 1].sum() / max((a * n).sum(), 1e-300)
    gini = lambda on: 2 * (a * n)[on & (y == 0)].sum() * (a * n)[on & (y == 1)].sum() / max((a * n)[on].sum(), 1e-300)
    every, best = np.ones(len(y), bool), None
    if depth:
        for f in range(x.shape[1]):
            for e in edges[f]:
                left = x[:, f] <= e
                if n[left].sum() >= least and n[~left].sum() >= least:
                    cost = gini(left) + gini(~left)
                    if cost < gini(every) - 1e-12 and (best is None or cost < best[0] - 1e-9):
                        best = cost, f, e
    if best is None:
        return lambda z: np.full(len(z), share)
    _, f, e = best
    left = x[:, f] <= e
    one, two = (tree(x[on], y[on], a[on], n[on], edges, depth - 1, least) for on in (left, ~left))
    return lambda z: np.where(z[:, f] <= e, one(z), two(z))


def test_trees_against_a_search(data):
    p, s, v = data
    for depth, leaf in ((2, 1), (3, 8)):
        done = learners.grow(p, DESIGN, s, 1, depth, [leaf], 3, sampled=False)
        for t, on in sets(v):
            y = v["y"].astype(int)
            want = tree(v["x"][on], y[on], s.weight[t][y[on]], np.ones(on.sum()), s.edges[t], depth, leaf)
            assert np.abs(done[t].score(v["x"], depth) - want(v["x"])).max() < 1e-9


def test_forest(data):
    p, s, v = data
    fitted = learners.fit_forest(p, DESIGN, s, 30, [1, 3], [2, 8], 7)
    again = learners.fit_forest(p.repartition(7), DESIGN, s, 30, [1, 3], [2, 8], 7)
    got = oof(p, fitted)
    assert np.abs(got - oof(p, again)).max() < 1e-9 and not np.isnan(got).any()
    y = v["y"]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in got[y == 1] for b in got[y == 0]])
    assert auc > 0.8
    n = learners.draws(np.random.default_rng(0).integers(-(2**62), 2**62, 4000), 50, 3)
    assert abs(n.mean() - 1) < 0.02 and abs(n.var() - 1) < 0.03


def test_rules_and_readings(spark):
    rows = [(1, 2.0, -1.0, 0.0, 1), (2, 0.0, 3.0, 1.0, 1), (3, -1.0, 0.0, 2.0, 0), (4, 0.0, 0.0, 0.0, 0), (5, 1.0, 1.0, -1.0, 1)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    turn = learners.directions(df, ["a", "b", "c"], "y")
    want = {f: 1 if sum((r[k] > 0) == (r[4] == 1) for r in rows) >= sum((r[k] < 0) == (r[4] == 1) for r in rows) else -1 for f, k in (("a", 1), ("b", 2), ("c", 3))}
    assert turn == want
    rules = learners.hand_rules(["a", "b", "c"], {"a": 1, "b": 1, "c": -1})
    got = {r.id: r.asDict() for r in df.select("id", *(c.alias(n) for n, c in rules.items())).collect()}
    assert [got[i]["lex2"] for i in range(1, 6)] == [True, True, False, False, True] and [got[i]["lex3"] for i in range(1, 6)] == [True, True, False, False, True]
    assert [got[i]["vote3"] for i in range(1, 6)] == [False, False, False, False, True] and [got[i]["sign_c"] for i in range(1, 6)] == [False, False, False, False, True]
    both = learners.both_ways(df, "id", ["a", "b", "c"], "y")
    scored = both.withColumn("score", F.col("a"))
    out = {r.id: (r.s, r.agrees) for r in learners.antisymmetric(scored, "id").collect()}
    assert out == {1: (4.0, True), 2: (0.0, False), 3: (-2.0, True), 4: (0.0, False), 5: (2.0, True)}


def test_permuted_features_against_the_deals(data):
    """Each repeat is a permutation inside its fold, the same in any partitioning, and the drop is what it costs."""
    p, s, v = data
    fitted = learners.fit_logistic(p, DESIGN, s, [3.0])
    deals = learners.shuffled(p, ["fold"], "id", "x", 3, 4).collect()
    again = {(r.repeat, r.id): r.given_ for r in learners.shuffled(p.repartition(5), ["fold"], "id", "x", 3, 4).collect()}
    assert {(r.repeat, r.id): r.given_ for r in deals} == again and len(deals) == 3 * 320
    lost, moved = np.zeros(4), 0
    for k in (1, 2, 3):
        for o in range(3):
            own = [r for r in deals if r.repeat == k and r.fold == o]
            assert sorted(map(tuple, (r.x for r in own))) == sorted(map(tuple, (r.given_ for r in own)))
            moved += sum(r.x != r.given_ for r in own)
            x, g, y = np.array([r.x for r in own]), np.array([r.given_ for r in own]), np.array([r.y for r in own])
            right = lambda z, o=o, y=y: ((fitted.predict(DESIGN.at(o, DESIGN.inner), 0, z) >= 0.5) == (y > 0)).sum()
            for j in range(4):
                z = x.copy()
                z[:, j] = g[:, j]
                lost[j] += right(x) - right(z)
    got = {r.feature: r["drop"] for r in learners.permutation_drop(p, DESIGN, fitted, dict.fromkeys(range(3), 0), 3, 4).collect()}
    assert moved > 900 and all(abs(got[j] - lost[j] / 960) < 1e-12 for j in range(4)) and got[0] > 0.05


def test_arrays_of_a_forest_score_as_the_forest(spark):
    """Parity of the exported arrays with the fitted model's own probabilities."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tallyloom.operators import models

    rng = np.random.default_rng(2)
    rows = [(i, x.tolist(), float(x[0] + x[1] ** 2 > 0.8)) for i, x in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "id int, x array<double>, y double").withColumn("features", array_to_vector("x"))
    model = RandomForestClassifier(labelCol="y", numTrees=7, maxDepth=4, seed=1).fit(df)
    want = {r.id: r.p for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.id: r.score for r in models.score_forest(df, models.tree_arrays(model), "x", ["id"]).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12

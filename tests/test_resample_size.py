"""Resampling at size: what is multiplied is dealt out first, and a digest is taken once."""

import hashlib
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import learners, models, resample


def number(*by):
    u = (int(hashlib.md5(":".join(str(b) for b in by if b is not None).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    return sum(u >= c for c in resample.POISSON)


def test_two_stages_against_plain_loops_and_dealt_out(spark):
    rows = [(None if r == 3 else f"r{r}", s, (r * 7 + s) % 3) for r in range(6) for s in range(4)]
    df = spark.createDataFrame(rows, "repo string, scope long, hit long")
    out = resample.two_stage_bootstrap(df, "repo", "scope", F.sum("hit"), F.count("*"), 40, 3)
    want = {}
    for d in range(40):
        w = [(h, sum(number(4, d, r, s, k) for k in range(1, number(3, d, r) + 1))) for r, s, h in rows]
        want[d] = sum(h * n for h, n in w) / t if (t := sum(n for _, n in w)) else None
    got = {r.draw: r.share for r in out.collect()}
    assert all(abs(got[d] - w) < 1e-12 if w is not None else got.get(d) is None for d, w in want.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the few clusters go to all cores before they meet 2000 draws, and no digest is taken inside a function of arrays
    assert "REPARTITION_BY_NUM" in plan and not any("md5" in line and "lambda" in line for line in plan.splitlines())


def test_a_large_key_is_dealt_out_and_draws_as_the_plain_bootstrap(spark, monkeypatch):
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 900, 700) / 10, rng.integers(0, 900, 800) / 10 + 4
    rows = [("big", 0, float(v)) for v in left] + [("big", 1, float(v)) for v in right] + [("one arm", 0, 1.0), ("tie", 0, 1.0), ("tie", 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, arm int, v double")
    delta = lambda a, b: (np.sign(b[None, :] - a[:, None])).sum() / (len(a) * len(b))
    plain = [delta(rng.choice(left, len(left)), rng.choice(right, len(right))) for _ in range(400)]
    monkeypatch.setattr(resample, "VALUES", 50)
    out = resample.pair_bootstrap(df, "k", "arm", "v", 2000, 5)
    got = {r.k: r for r in out.collect()}
    assert abs(got["big"].delta - delta(left, right)) < 1e-12
    assert abs(got["big"].low - np.quantile(plain, 0.025)) < 0.02 and abs(got["big"].high - np.quantile(plain, 0.975)) < 0.02
    assert (got["tie"].delta, got["tie"].low, got["tie"].high) == (0, 0, 0) and got["one arm"].delta is None
    # cells of one key agree on how many rows each draws
    cells = [([3, 1], [4, 10, 6]), ([2, 2], [4, 5, 7])]
    n = [resample._cell_sums(1, m, [(own, sizes) for own, sizes in cells], 300, 5) for m in range(3)]
    assert (sum(c[0][1:] for c in n) == 20).all() and (sum(c[1][1:] for c in n) == 16).all()


def test_a_permutation_test_deals_its_rows_once(spark, monkeypatch):
    kept, own = [], models.stored
    monkeypatch.setattr(models, "stored", lambda df: (kept.append(out := own(df)), out)[1])
    df = spark.createDataFrame([(i, f"g{i % 5}", i % 2, i % 3 % 2, int(i % 7 < 3)) for i in range(200)], "id long, g string, a int, b int, y int")
    row = models.permutation_test(df, "id", "g", ["a", "b"], "y", 10, 1).first()
    assert row.draws == 10 and len(kept) == 1
    # the plan reads counts of cells: nothing behind the stored table explodes rows into draws again
    assert kept[0].agg(F.sum("rows_")).first()[0] == 200 * 11 and kept[0].count() < 11 * 5 * 4 * 2 + 1


def test_a_full_batch_meets_trees_in_blocks():
    rng = np.random.default_rng(1)
    h, x = rng.integers(-(2**62), 2**62, 500), rng.normal(size=(20_000, 3))
    assert (learners.draws(h, 10, 7)[:, 4:] == learners.draws(h, 6, 7, 4)).all()
    trees = learners.Trees(rng.integers(0, 3, (200, 7)), rng.normal(size=(200, 7)), rng.random((200, 7)))
    tracemalloc.start()
    score = trees.score(x, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000 * 200 * 8 and np.array_equal(score[:50], trees.score(x[:50], 2))

"""Bootstraps with the survey's 2000 draws, and no id of a method that is not there."""

import math
import random

from pyspark.sql import functions as F

from tallyloom.operators import models, resample
from tallyloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_bootstraps_draw_2000_times(spark, monkeypatch):
    assert catalogue.QUERIES["cluster_bootstrap"](spark, SF).count() == 2000
    assert 1900 <= catalogue.QUERIES["group_bootstrap"](spark, SF).first().used <= 2000
    seen, own = [], resample.pair_bootstrap
    monkeypatch.setattr(resample, "pair_bootstrap", lambda *a: (seen.append(a[4]), own(*a))[1])
    assert catalogue.QUERIES["pair_bootstrap"](spark, SF).count() > 0 and seen == [2000]


def test_methods_that_are_left_out_are_not_claimed():
    assert not {"MLE01", "MLE02"} & {i for ids in catalogue.IDS.values() for i in ids.split()}


def test_the_two_stage_bootstrap_spreads_more_than_its_inner_clusters(spark):
    rows = [(r, s, int((r * 7 + s) % 3 == 0)) for r in range(20) for s in range(5) for _ in range(4)]
    df = spark.createDataFrame(rows, "repo long, scope long, hit long")
    d = [r.share for r in resample.two_stage_bootstrap(df, "repo", "scope", F.sum("hit"), F.count("*"), 500, 3).collect()]
    true = sum(r[2] for r in rows) / len(rows)
    assert len(d) == 500 and abs(sum(d) / 500 - true) < 0.02 and min(d) < true < max(d)


def test_leave_one_out_retrains(spark):
    """Against a learner that is trained anew on the other groups."""
    rng = random.Random(4)
    rows = [(i, i % 5, int(rng.random() < 0.4), int(rng.random() < 0.5), int(rng.random() < 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g long, y int, a int, b int")
    want = {}
    for g in range(5):
        rest = [r for r in rows if r[1] != g]
        n = {c: sum(r[2] == c for r in rest) for c in (0, 1)}
        hits = 0
        for r in (r for r in rows if r[1] == g):
            z = math.log((n[1] + 1) / (n[0] + 1))
            for f in (3, 4):
                p = {c: (sum(x[f] for x in rest if x[2] == c) + 1) / (n[c] + 2) for c in (0, 1)}
                z += math.log(p[1] / p[0]) if r[f] else math.log((1 - p[1]) / (1 - p[0]))
            hits += int(z > 0) == r[2]
        want[g] = (40, hits)
    assert {r.g: (r.n, r.hits) for r in models.leave_one_out_bayes(df, [], "g", ["a", "b"], "y").collect()} == want
    draws = models.shuffled_labels(df, "id", "y", 3, 1).groupBy("draw").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.count_distinct("id").alias("ids")).collect()
    assert {(r.n, r.y, r.ids) for r in draws} == {(200, sum(r[2] for r in rows), 200)} and len(draws) == 4
    copy = spark.createDataFrame([(i, i % 5, i % 2, i % 2, 0) for i in range(200)], "id long, g long, y int, a int, b int")
    got = models.permutation_test(copy, "id", "g", ["a", "b"], "y", 40, 1).first()
    assert got.observed == 1.0 and got.p_value == 1 / 41 and got.chance < 0.7

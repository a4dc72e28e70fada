"""What the n-gram Jaccard join sends about: the sets once, whatever the size of its tables."""

import random

import numpy as np

from tallyloom.llm import jaccard_join


def sent(spark):
    """Bytes written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(e.totalShuffleWrite() for e in (lambda all_: [all_.apply(k) for k in range(all_.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def made(spark, tmp_path, pairs, n, size):
    """Written pairs and n sets of `size` shingles, nine tenths of each in the next; every third of a set is rare."""
    values = np.random.default_rng(3).integers(0, 1 << 62, (n + 9, size // 10), np.uint64)
    sets = [np.sort(values[k : k + 10].ravel()) for k in range(n)]
    rare = np.packbits(np.arange(size) % 3 == 0).tobytes()
    spark.createDataFrame([(k, s.tobytes(), rare) for k, s in enumerate(sets)], "node long, shingles binary, rare binary").write.parquet(f"{tmp_path}/sets")
    spark.createDataFrame(pairs, "x long, y long").write.parquet(f"{tmp_path}/pairs")
    return spark.read.parquet(f"{tmp_path}/pairs"), spark.read.parquet(f"{tmp_path}/sets"), sets


def test_sets_pass_one_exchange(spark, tmp_path):
    pairs, sets, all_ = made(spark, tmp_path, [(k, k + 1) for k in range(0, 1200, 60)], 1300, 200)
    size = sum(s.nbytes for s in all_)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as when no table is small
    try:
        for job in (jaccard_join.compare, lambda p, s: jaccard_join.verify(p, s).collect()):
            before = sent(spark)
            job(pairs, sets)
            assert size / 2 < sent(spark) - before < 1.3 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_hot_sets_meet_all_their_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "SALTS", 4)
    rng = random.Random(2)
    pairs = {(5, k) for k in range(6, 40)} | {(k, 41) for k in range(41)} | {tuple(sorted(rng.sample(range(42), 2))) for _ in range(60)}
    p, s, sets = made(spark, tmp_path, sorted(pairs), 42, 60)
    few = np.arange(60) % 3 == 0
    want = {}
    for x, y in pairs:
        both = np.isin(sets[x], sets[y])
        k = int(both.sum())
        want[x, y] = (60 - k, int((~both & ~few).sum()), 100 * k >= 75 * (120 - k))
    assert 0 < sum(v[2] for v in want.values()) < len(want)
    got = jaccard_join.compare(p, s).collect()
    assert len(got) == len(pairs) and {(r.x, r.y): (r.lost, r.own, r.linked) for r in got} == want
    assert {(r.x, r.y) for r in jaccard_join.verify(p, s).collect()} == {k for k, v in want.items() if v[2]}
    # the list of hot nodes is bounded, whatever the pairs
    monkeypatch.setattr(jaccard_join, "MOST", 1)
    assert {(r.x, r.y): r.lost for r in jaccard_join.compare(p, s).collect()} == {k: v[0] for k, v in want.items()}

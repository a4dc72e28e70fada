"""Fact and contrast queries over all events against brute force."""

import random
from collections import defaultdict

import pytest

from tallyloom.plans import catalogue


@pytest.fixture
def events(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, rng.choice([1, 39, 40, 77, 1500]), rng.choice(["view", "click", "error", "purchase"]), rng.choice([3.5, 20.0, 50.2, 86.0, 95.0])) for k in range(60)] + [(60, 9, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path), rows


def test_drops_of_every_event(spark, events):
    sf, rows = events
    takes, want = {"view": ["child"], "click": ["child", "body"]}, defaultdict(set)
    for k, user, kind, _ in rows:
        param = ["child", "body", "extra"][k % 3]
        want[user] |= {f"{kind}.{param}"} if param not in takes.get(kind, param) else set()
    assert {r.k: r.drops for r in catalogue.QUERIES["shim_drops"](spark, sf).collect()} == {u: ",".join(sorted(d)) for u, d in want.items()}


def test_relations_of_every_event(spark, events):
    sf, rows = events
    side = defaultdict(lambda: (set(), set()))
    for k, user, kind, _ in rows:
        side[user][k % 2].add(kind)
    names = {(True, True): "both", (True, False): "added", (False, True): "removed", (False, False): "identical"}
    assert {r.user_id: r.relation for r in catalogue.QUERIES["binding_relation"](spark, sf).collect()} == {u: names[bool(b - a), bool(a - b)] for u, (a, b) in side.items()}

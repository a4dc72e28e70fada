"""Windows of every run, each sample in one at most, against brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from tallyloom.plans import catalogue


@pytest.fixture
def events(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.randint(1, 3), rng.choice(["view", "click"]), float(rng.randint(0, 100)), 60 * rng.randint(0, 300)) for k in range(90)]
    start = datetime(2024, 1, 1)
    spark.createDataFrame([(*r[:4], start + timedelta(seconds=r[4])) for r in rows], "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    own = defaultdict(list)
    for e in rows:
        inside = [(w[4] + 1800, w[0]) for w in rows if w[1] == e[1] and w[4] <= e[4] <= w[4] + 1800]
        own[min(inside)[1]].append(e)
    return str(tmp_path), rows, own


def test_every_run_has_a_summary(spark, events):
    sf, rows, own = events
    got = {r.run: (r.n_samples, r.low, r.high, r.kinds) for r in catalogue.QUERIES["window_summary"](spark, sf).collect()}
    assert got == {r[0]: (len(o), min(x[3] for x in o), max(x[3] for x in o), ",".join(sorted({x[2] for x in o}))) if (o := own.get(r[0])) else (0, None, None, None) for r in rows}


def test_samples_are_lost_to_no_window_and_doubled_in_none(spark):
    """Gaps between runs leave samples apart; rows are counted on both sides."""
    rows = catalogue.QUERIES["interval_conservation"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.samples == r.assigned + r.unassigned and r.assigned and r.unassigned for r in rows)
    phases = {r.phase for r in catalogue.QUERIES["telemetry_split"](spark, "/root/testdata/sf0.01").collect()}
    assert phases == {"setup", "measure", "unassigned"}


def test_every_run_has_its_nearest_sample(spark, events):
    sf, rows, own = events
    want = {r[0]: min(own[r[0]], key=lambda x: (abs(x[4] - r[4] - 600), x[4], x[0]))[0] if r[0] in own else None for r in rows}
    assert {r.run: r.event_id for r in catalogue.QUERIES["nearest_sample"](spark, sf).collect()} == want

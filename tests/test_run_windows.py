"""Windows of runs against one loop a session; samples against a search over all windows."""

import math
import random
import statistics
from collections import defaultdict

import pytest

from tallyloom.operators import windows

KEYS = ["user", "session"]
RUNS = "user int, session int, run long, end long, started long, preflight long, span long, session_start long"


def loop(runs, fallback):
    """(run, source, setup_start, measure_start, end) of one session."""
    runs = sorted((r for r in runs if r[3] is not None), key=lambda r: (r[3], r[2]))
    spans = [e - s if s is not None else d for _, _, _, e, s, _, d, _ in runs if s is not None or d is not None]
    usual = math.floor(statistics.median(spans)) if spans else fallback
    out, prev = [], None
    for _, _, run, end, started, preflight, span, opened in runs:
        measure = started if started is not None else end - (span or usual)
        setup = preflight if preflight is not None else prev if prev is not None else measure
        source = "header" if started is not None else "device" if span else "median"
        out.append([run, source, setup, measure, end, preflight, opened])
        prev = end
    pads = [m - s for _, _, s, m, *_ in out[1:] if m > s]
    if out and out[0][5] is None:
        floor = out[0][3] - (math.floor(statistics.median(pads)) if pads else 0)
        out[0][2] = floor if out[0][6] is None else max(floor, out[0][6])
    prev, done = None, []
    for run, source, setup, measure, end, *_ in out:
        if prev is not None:
            setup, measure = max(setup, prev), max(measure, prev)
        done.append((run, source, min(setup, measure), min(measure, end), end))
        prev = end
    return done


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(4)
    maybe = lambda x, p=0.5: x if rng.random() < p else None
    rows = []
    for user in range(6):
        for session in range(4):
            opened = maybe(rng.randint(-200, 100))
            for run in range(rng.choice([1, 1, 2, 5, 12])):
                end = rng.randint(0, 1500)
                started = maybe(end - rng.randint(0, 400))
                rows.append((user, session, run, maybe(end, 0.95), started, maybe(end - rng.randint(300, 600), 0.2), maybe(rng.choice([0, 0, 50, 301])), opened))
    rows += [(9, 0, 1, 100, None, None, None, None), (9, 1, 1, None, 5, None, None, None), (9, 2, 1, 100, None, None, 0, 90), (9, 2, 2, 100, 80, None, 0, 90)]
    return rows


@pytest.mark.parametrize("width", [7, 100, 10**6])
def test_windows_against_a_loop(spark, runs, width):
    by = defaultdict(list)
    for r in runs:
        by[r[:2]].append(r)
    got = windows.build_windows(spark.createDataFrame(runs, RUNS).repartition(3), KEYS, 60, width).collect()
    assert sorted(map(tuple, got)) == sorted((*k, *w) for k, own in by.items() for w in loop(own, 60))
    assert {r.source for r in got} == {"header", "device", "median"}


@pytest.mark.parametrize("width", [13, 10**6])
def test_samples_lie_in_one_window(spark, runs, width):
    rng = random.Random(5)
    w = windows.build_windows(spark.createDataFrame(runs, RUNS), KEYS, 60, 100)
    every = defaultdict(list)
    for r in w.collect():
        every[r.user, r.session].append((r.end, r.run, r.setup_start))
    points = [(k, rng.randint(0, 7), rng.randint(0, 3), rng.choice([rng.randint(-400, 1600), *(x[0] for v in every.values() for x in v)])) for k in range(900)] + [(900, 1, 1, None), (901, None, 1, 5)]
    got = windows.assign(spark.createDataFrame(points, "id long, user int, session int, at long"), w, KEYS, "at", "setup_start", "run", width).collect()
    want = {i: min((x for x in every[u, s] if x[2] <= t <= x[0]), default=(None, None))[1] if t is not None else None for i, u, s, t in points}
    assert {r.id: r.w_.run if r.w_ else None for r in got} == want and len(got) == len(points)
    assert 100 < sum(v is None for v in want.values()) < 800


def test_median_is_exact(spark):
    rng = random.Random(6)
    rows = [(k % 3, rng.choice([None, 0.0, -5.0, rng.uniform(-1e9, 1e9), rng.uniform(0, 2)])) for k in range(500)] + [(7, None), (8, 4.0)]
    got = {r.k: r.m for r in windows.median_by(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", "m").collect()}
    assert got == {k: statistics.median([v for q, v in rows if q == k and v is not None]) for k in (0, 1, 2, 8)}

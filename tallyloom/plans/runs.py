"""Runs of a session and their telemetry: every seventh event ends a run, the others are samples; a session is a user's week."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from ..sources.tables import cut, events
from .registry import query

S, DAY = 1_000_000, 86_400_000_000
KEYS = ["user_id", "week"]
FALLBACK = 60 * S

_RUNS = f"""
ev AS (SELECT event_id, user_id, value, epoch_us(ts) AS us, epoch_us(ts) // {7 * DAY} AS week FROM events),
r AS (SELECT user_id, week, event_id AS run, us AS e, value, CASE WHEN event_id % 3 > 0 THEN us - event_id % 900 * {400 * S} END AS started,
  CASE WHEN event_id % 6 = 0 THEN event_id % 400 * {500 * S} END AS span, CASE WHEN event_id % 12 = 7 THEN us - event_id % 900 * {400 * S} - {7200 * S} END AS preflight,
  CASE WHEN user_id % 2 = 0 THEN min(us) OVER (PARTITION BY user_id, week) - {144_000 * S} END AS session_start FROM ev WHERE event_id % 7 = 0),
u AS (SELECT user_id, week, CAST(floor(median(CASE WHEN started IS NULL THEN span ELSE e - started END)) AS BIGINT) AS usual FROM r GROUP BY 1, 2),
a AS (SELECT r.*, lag(e) OVER (PARTITION BY r.user_id, r.week ORDER BY e, run) AS prev, coalesce(started, CASE WHEN coalesce(span, 0) = 0 THEN e - coalesce(usual, {FALLBACK}) ELSE e - span END) AS m0 FROM r JOIN u ON u.user_id = r.user_id AND u.week = r.week),
b AS (SELECT *, coalesce(preflight, prev, m0) AS s0 FROM a),
p AS (SELECT user_id, week, CAST(floor(coalesce(median(m0 - s0) FILTER (prev IS NOT NULL AND m0 > s0), 0)) AS BIGINT) AS pad FROM b GROUP BY 1, 2),
c AS (SELECT b.*, CASE WHEN prev IS NULL AND preflight IS NULL THEN greatest(m0 - pad, coalesce(session_start, m0 - pad)) ELSE s0 END AS s1 FROM b JOIN p ON p.user_id = b.user_id AND p.week = b.week),
w AS (SELECT user_id, week, run, value, CASE WHEN started IS NOT NULL THEN 'header' WHEN coalesce(span, 0) > 0 THEN 'device' ELSE 'median' END AS source,
  least(greatest(s1, coalesce(prev, s1)), greatest(m0, coalesce(prev, m0))) AS a, least(greatest(m0, coalesce(prev, m0)), e) AS m, e AS z FROM c)"""
#: Windows do not overlap but may touch, where the earlier one has the sample.
_SAMPLES = _RUNS + """,
j AS (SELECT * FROM (SELECT ev.event_id, ev.value, ev.us, w.run, w.a, w.m, w.z, w.source, w.value AS noted, row_number() OVER (PARTITION BY ev.event_id ORDER BY w.z, w.run) AS k
  FROM ev JOIN w ON w.user_id = ev.user_id AND w.week = ev.week AND ev.us BETWEEN w.a AND w.z WHERE ev.event_id % 7 > 0) WHERE k = 1)"""


def _runs(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "value", "us", F.floor(F.col("us") / (7 * DAY)).alias("week"))
    k = F.col("event_id")
    started = F.when(k % 3 > 0, F.col("us") - k % 900 * (400 * S))
    runs = e.filter(k % 7 == 0).select(*KEYS, k.alias("run"), F.col("us").alias("end"), F.col("value").alias("noted"), started.alias("started"), F.when(k % 6 == 0, k % 400 * (500 * S)).alias("span"), F.when(k % 12 == 7, started - 7200 * S).alias("preflight"))
    opened = runs.groupBy(*KEYS).agg(F.min("end").alias("first"))
    opened = opened.select(*KEYS, F.when(F.col("user_id") % 2 == 0, F.col("first") - 144_000 * S).alias("session_start"))
    return e.filter(k % 7 > 0), runs.join(opened, KEYS)


def _windows(spark, sf):
    samples, runs = _runs(spark, sf)
    return samples, windows.build_windows(runs, KEYS, FALLBACK, DAY), runs.select(*KEYS, "run", "noted")


def _assigned(spark, sf):
    samples, w, noted = _windows(spark, sf)
    return samples, w, noted, windows.assign(samples, w, KEYS, "us", "setup_start", "run", DAY)


@query("WIN07 WIN08 WIN09", f"WITH {_RUNS} SELECT user_id, week, run, source, a AS setup_start, m AS measure_start, z AS \"end\" FROM w")
def run_windows(spark, sf):
    """Exact, device-sized and median-sized runs, overlapping ones clamped, sessions of one run among them."""
    return _windows(spark, sf)[1]


@query("JOI07 INC15", f"""
WITH {_SAMPLES} SELECT week, count(*) AS samples, count(j.event_id) AS assigned, count(*) FILTER (j.event_id IS NULL) AS unassigned
FROM ev LEFT JOIN j ON j.event_id = ev.event_id WHERE ev.event_id % 7 > 0 GROUP BY 1""")
def interval_conservation(spark, sf):
    """By week: rows of the input, and rows of the assignment counted one by one; a sample lost or doubled would show."""
    samples, _, _, j = _assigned(spark, sf)
    n = samples.groupBy("week").agg(F.count("*").alias("samples"))
    return n.join(j.groupBy("week").agg(F.count("w_").alias("assigned"), F.count_if(F.col("w_").isNull()).alias("unassigned")), "week", "left")


@query("SNK09 SNK10", f"""
WITH {_SAMPLES} SELECT coalesce(j.run, -1) AS run, CASE WHEN j.run IS NULL THEN 'unassigned' WHEN j.us >= j.m THEN 'measure' ELSE 'setup' END AS phase, count(*) AS samples, round(max((j.us - j.a) / {S}.0), 3) AS last_elapsed_s
FROM ev LEFT JOIN j ON j.event_id = ev.event_id WHERE ev.event_id % 7 > 0 GROUP BY 1, 2""")
def telemetry_split(spark, sf):
    """Every sample with its run, phase and seconds since the run's setup began; samples of no run apart."""
    j = _assigned(spark, sf)[3]
    w = lambda c: F.col(f"w_.{c}")
    phase = F.when(F.col("w_").isNull(), "unassigned").when(F.col("us") >= w("measure_start"), "measure").otherwise("setup")
    rows = j.select(F.coalesce(w("run"), F.lit(-1)).alias("run"), phase.alias("phase"), ((F.col("us") - w("setup_start")) / S).alias("run_elapsed_s"))
    return rows.groupBy("run", "phase").agg(F.count("*").alias("samples"), F.round(F.max("run_elapsed_s"), 3).alias("last_elapsed_s"))


@query("INC16", f"""
WITH {_SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(us - m), us, event_id) AS r FROM j)
SELECT source, count(*) AS runs, round(median(d), 6) AS median, round(min(d), 6) AS low, round(max(d), 6) AS high, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM (SELECT source, abs(value - noted) AS d FROM n WHERE r = 1) GROUP BY 1""")
def window_alignment(spark, sf):
    """By where a window's start comes from: how far the sample nearest to it is from the value that the run noted."""
    _, _, noted, j = _assigned(spark, sf)
    near = F.min_by("value", F.struct(F.abs(F.col("us") - F.col("measure_start")), "us", "event_id"))
    hit = j.filter("w_ IS NOT NULL").select(*KEYS, "event_id", "us", "value", "w_.run", "w_.source", "w_.measure_start")
    d = hit.groupBy(*KEYS, "run", "source").agg(near.alias("value")).join(noted, [*KEYS, "run"]).withColumn("d", F.abs(F.col("value") - F.col("noted")))
    d = cut(d.select("source", "d"))
    r = lambda f: F.round(f("d"), 6)
    rest = d.groupBy("source").agg(F.count("*").alias("runs"), r(F.min).alias("low"), r(F.max).alias("high"), r(F.avg).alias("mean"), r(F.stddev_samp).alias("sd"))
    return rest.join(windows.median_by(d, ["source"], "d", "median"), "source").withColumn("median", F.round("median", 6))

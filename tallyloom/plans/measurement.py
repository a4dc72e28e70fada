"""Measurement queries: schedules, warm-up, drift, windows of time, device state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, ordered, stats, windows
from ..sources.tables import events, read
from .registry import query

R = lambda c, n=6: F.round(c, n)
#: Microseconds of a cell of time.
DAY = 86_400_000_000


@query("AGG08 SCA11 MLE21", """
WITH e AS (SELECT event_type, user_id % 2 AS arm, value FROM events WHERE value IS NOT NULL),
p AS (SELECT l.event_type, count(*) AS n, avg(sign(r.value - l.value)) AS d FROM e l JOIN e r ON l.event_type = r.event_type AND l.arm = 0 AND r.arm = 1 GROUP BY 1)
SELECT event_type, round(d, 6) AS delta, CASE WHEN abs(d) < 0.147 THEN 'negligible' WHEN abs(d) <= 0.33 THEN 'small' WHEN abs(d) < 0.474 THEN 'medium' ELSE 'large' END AS band,
CAST(d > 0.33 AS BIGINT) AS label FROM p""")
def cliffs_delta_labels(spark, sf):
    e = events(spark, sf).filter("value IS NOT NULL").select("event_type", F.pmod("user_id", F.lit(2)).alias("arm"), "value")
    d = stats.cliffs_delta(e, ["event_type"], "arm", "value")
    return d.select("event_type", R(F.col("delta")).alias("delta"), stats.effect_band(F.col("delta")).alias("band"), (F.col("delta") > 0.33).cast("long").alias("label"))


@query("WIN02 FLT17 AGG05 AGG06", """
WITH i AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx FROM events)
SELECT user_id, event_type, count(*) AS n_raw, CASE WHEN count(*) > 10 THEN count(*) - 10 ELSE count(*) END AS n_used, CASE WHEN count(*) > 10 THEN 10 ELSE 0 END AS warmup_dropped,
round(CASE WHEN count(*) > 10 THEN median(value) FILTER (idx >= 10) ELSE median(value) END, 6) AS median FROM i GROUP BY 1, 2""")
def warmup_trimmed_median(spark, sf):
    """Every user and type; where nothing follows the warm-up all rows count."""
    keys = ["user_id", "event_type"]
    m = ordered.trimmed_median(events(spark, sf), keys, ["us", "event_id"], "value", 10)
    return m.select(*keys, "n_raw", "n_used", "warmup_dropped", R(F.col("median")).alias("median"))


@query("AGG07", """
SELECT event_type, round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / median(value), 6) AS iqr_over_median, round(max(value) / median(value), 6) AS range_ratio FROM events GROUP BY 1""")
def spread_of_values(spark, sf):
    e = events(spark, sf)
    q = windows.quantiles_by(e, ["event_type"], "value", {"low": 0.25, "mid": 0.5, "high": 0.75})
    top = e.groupBy("event_type").agg(F.max("value").alias("top"))
    return q.join(top, "event_type").select("event_type", R((F.col("high") - F.col("low")) / F.col("mid")).alias("iqr_over_median"), R(F.col("top") / F.col("mid")).alias("range_ratio"))


@query("WIN01", """
SELECT event_id, round((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY user_id), 6) AS pos FROM events""")
def schedule_position(spark, sf):
    return ordered.schedule_position(events(spark, sf), ["user_id"], ["us", "event_id"]).select("event_id", R(F.col("pos")).alias("pos"))


@query("WIN10 FLT02", """
WITH p AS (SELECT event_type, user_id % 3 AS role, ln(value + 1) AS y, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY event_type) AS x FROM events WHERE value >= 0),
d AS (SELECT event_type, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM p WINDOW w AS (PARTITION BY event_type, role))
SELECT event_type, count(*) AS n, round(sum(x * y) / sum(x * x), 6) AS slope FROM d GROUP BY 1""")
def drift_adjusted_slope(spark, sf):
    e = events(spark, sf).filter("value >= 0").select("event_type", F.pmod("user_id", F.lit(3)).alias("role"), "us", "event_id", F.log(F.col("value") + 1).alias("y"))
    p = ordered.schedule_position(e, ["event_type"], ["us", "event_id"])
    return stats.drift_slope(p, "event_type", "role", "pos", "y").select("event_type", "n", R(F.col("slope")).alias("slope"))


_WINDOWS = """w AS (SELECT user_id, event_id AS run, epoch_us(ts) AS a, epoch_us(ts) + 1800000000 AS b FROM events),
j AS (SELECT * FROM (SELECT e.event_id, e.value, e.event_type, epoch_us(e.ts) AS us, w.run, w.a, row_number() OVER (PARTITION BY e.event_id ORDER BY w.b, w.run) AS k
  FROM events e JOIN w ON e.user_id = w.user_id AND epoch_us(e.ts) BETWEEN w.a AND w.b) WHERE k = 1)"""


def _assigned(spark, sf):
    """The window of every run, and each sample in the first by end of the windows it lies in."""
    e = events(spark, sf)
    w = e.select("user_id", F.col("event_id").alias("run"), F.col("us").alias("a"), (F.col("us") + 1_800_000_000).alias("end"))
    j = windows.assign(e, w, ["user_id"], "us", "a", "run", DAY).filter("w_ IS NOT NULL")
    return w.drop("end"), j.select(*e.columns, "w_.run", "w_.a")


@query("JOI07 AGG09", f"""
WITH {_WINDOWS}, s AS (SELECT run, count(*) AS n, round(min(value), 6) AS low, round(avg(value), 3) AS mean, round(max(value), 6) AS high, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM j GROUP BY 1)
SELECT w.run, coalesce(s.n, 0) AS n_samples, low, mean, high, kinds FROM w LEFT JOIN s ON s.run = w.run""")
def window_summary(spark, sf):
    """Every run; one whose window got no sample has n_samples 0."""
    w, j = _assigned(spark, sf)
    s = j.groupBy("run").agg(F.count("*").alias("n"), R(F.min("value")).alias("low"), R(F.avg("value"), 3).alias("mean"), R(F.max("value")).alias("high"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    return w.select("run").join(s, "run", "left").select("run", F.coalesce("n", F.lit(0)).alias("n_samples"), "low", "mean", "high", "kinds")


@query("JOI08", f"""
WITH {_WINDOWS}, n AS (SELECT run, event_id, row_number() OVER (PARTITION BY run ORDER BY abs(us - (a + 600000000)), us, event_id) AS r FROM j)
SELECT w.run, n.event_id FROM w LEFT JOIN n ON n.run = w.run AND n.r = 1""")
def nearest_sample(spark, sf):
    """Every run; event_id is null where its window got no sample."""
    w, j = _assigned(spark, sf)
    n = joins.nearest(j.withColumn("target", F.col("a") + 600_000_000), ["run"], "us", "target", "event_id")
    return w.select("run").join(n.select("run", "event_id"), "run", "left")


@query("WIN08", """SELECT user_id, CASE WHEN count(*) >= 2 THEN epoch_us(max(ts)) - epoch_us(min(ts)) END AS span_us FROM events GROUP BY 1""")
def device_span(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.when(F.count("*") >= 2, F.max("us") - F.min("us")).alias("span_us"))


@query("WIN15", """
SELECT event_id, coalesce(last_value(CASE WHEN value >= 80 THEN 1 WHEN value <= 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT AS paused FROM events""")
def thermal_hysteresis(spark, sf):
    return ordered.hysteresis(events(spark, sf), ["user_id"], ["us", "event_id"], "value", 80, 20).select("event_id", F.col("paused").cast("long").alias("paused"))


@query("WIN14", """
WITH t AS (SELECT event_id, user_id, event_id AS e, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS top FROM events),
r AS (SELECT *, CASE WHEN lag(top) OVER (PARTITION BY user_id ORDER BY e) IS NULL OR top > lag(top) OVER (PARTITION BY user_id ORDER BY e) THEN e END AS rose FROM t)
SELECT event_id, e - last_value(rose IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stalled FROM r""")
def charge_stall(spark, sf):
    return ordered.stall(read(spark, sf, "events"), ["user_id"], "event_id", "value").select("event_id", "stalled")


@query("WIN16 WIN17", """
WITH m AS (SELECT user_id, event_id, event_type, value < 50 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT *, n - sum(CAST(f AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length, count(DISTINCT event_type) AS members FROM g WHERE f GROUP BY user_id, island""")
def weak_streaks(spark, sf):
    return ordered.streaks(read(spark, sf, "events"), ["user_id"], ["event_id"], F.col("value") < 50, "event_type").drop("island")


@query("WIN17", """
WITH m AS (SELECT user_id, event_id, event_type, value < 50 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT *, n - sum(CAST(f AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m),
s AS (SELECT user_id, count(*) AS l, count(DISTINCT event_type) AS k FROM g WHERE f GROUP BY user_id, island)
SELECT user_id, coalesce(bool_or(l >= 4 AND k >= 2), false) AS abort FROM s GROUP BY 1""")
def streak_abort(spark, sf):
    s = ordered.streaks(read(spark, sf, "events"), ["user_id"], ["event_id"], F.col("value") < 50, "event_type")
    return s.groupBy("user_id").agg(F.bool_or((F.col("length") >= 4) & (F.col("members") >= 2)).alias("abort"))


@query("RUL17", """
SELECT event_id, CASE WHEN value > 90 THEN 'cool' WHEN user_id % 100 <= 10 THEN 'pause' WHEN user_id % 100 < 30 THEN 'pause' ELSE 'proceed' END AS gate FROM events""")
def gate_decision(spark, sf):
    from ..operators.rules import gate

    return read(spark, sf, "events").select("event_id", gate(F.col("value"), F.pmod("user_id", F.lit(100)), 10, 30, 90.0).alias("gate"))


@query("FLT15 FLT16 FLT23 AGG27", """
SELECT user_id, count(*) FILTER (event_type = 'purchase') AS perf, count(*) FILTER (event_type = 'view') AS vm, greatest(count(*) FILTER (event_type = 'purchase'), count(*) FILTER (event_type = 'view')) >= 12 AS complete,
CASE WHEN count(*) FILTER (event_type = 'view') < count(*) FILTER (event_type = 'purchase') THEN 'stdout' ELSE 'vm' END AS source FROM events GROUP BY 1""")
def complete_capture(spark, sf):
    perf, vm = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")
    return read(spark, sf, "events").groupBy("user_id").agg(perf.alias("perf"), vm.alias("vm"), (F.greatest(perf, F.coalesce(vm, F.lit(0))) >= 12).alias("complete"), F.when(vm < perf, "stdout").otherwise("vm").alias("source"))


@query("SRC13", """
WITH u AS (SELECT 0 AS f, event_id AS i, user_id, event_type, value FROM events UNION ALL SELECT 1, event_id, user_id, event_type, value + 1 FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY f, i) AS k FROM u)
SELECT user_id, event_type, round(value, 6) AS value FROM r WHERE k = 1""")
def session_concat_first_wins(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    both = e.withColumn("f", F.lit(0)).unionByName(e.withColumn("f", F.lit(1)).withColumn("value", F.col("value") + 1))
    return ordered.first_of(both, ["user_id", "event_type"], ["f", "event_id"]).select("user_id", "event_type", R(F.col("value")).alias("value"))


@query("WIN13 SRC14", """
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1""")
def session_to_continue(spark, sf):
    n = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return ordered.first_of(n, ["user_id"], [F.desc("n"), F.desc("event_type")])


@query("SRT06 SRT04", """
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice NULLS LAST, o_orderkey) - 1) // 500 AS batch FROM orders""")
def cheapest_first_batches(spark, sf):
    return ordered.batches(read(spark, sf, "orders"), ["o_orderpriority"], [F.asc_nulls_last("o_totalprice"), "o_orderkey"], 500).select("o_orderkey", F.col("batch").cast("long").alias("batch"))


@query("AGG26", """
WITH o AS (SELECT c.c_nationkey AS item, sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS c FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY c DESC, item) AS r, sum(c) OVER (ORDER BY c DESC, item ROWS UNBOUNDED PRECEDING) AS run, sum(c) OVER () AS total, count(*) OVER () AS n FROM o)
SELECT min(r) FILTER (run >= total / 2) AS half_in, max(c::DOUBLE) FILTER (r = n // 2 + 1) AS upper_median, max(c)::DOUBLE AS largest FROM r""")
def cost_concentration(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))
    return ordered.half_holders(o, "c_nationkey", "cost").select("half_in", F.col("upper_median").cast("double").alias("upper_median"), F.col("largest").cast("double").alias("largest"))


@query("ext spread of types", """
SELECT event_type AS window_source, count(*) AS n, round(median(abs(value - 50)), 6) AS median_abs, round(min(abs(value - 50)), 6) AS low, round(max(abs(value - 50)), 6) AS high, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1""")
def alignment_score(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("window_source"), "value", F.abs(F.col("value") - 50).alias("d"))
    d, middle = F.col("d"), windows.median_by(e, ["window_source"], "d", "median_abs").withColumn("median_abs", R(F.col("median_abs")))
    return middle.join(e.groupBy("window_source").agg(F.count("*").alias("n"), R(F.min(d)).alias("low"), R(F.max(d)).alias("high"), R(F.stddev_samp("value")).alias("sd")), "window_source")


@query("AGG30 SCA21", """
WITH c AS (SELECT user_id, event_type, count(*) AS cnt FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, (cnt, event_type)) AS modal, round(sum(cnt) FILTER (event_type IN ('click', 'view'))::DOUBLE / sum(cnt), 6) AS share FROM c GROUP BY 1""")
def modal_class(spark, sf):
    c = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("cnt"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("cnt", "event_type")).alias("modal"), R(F.sum(F.when(F.col("event_type").isin("click", "view"), F.col("cnt"))) / F.sum("cnt")).alias("share"))


@query("SRC11 SCA26", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL""")
def json_readings(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))
    return e.filter("k IS NOT NULL")


@query("JOI09", """
SELECT e.event_id, CASE WHEN s.s_suppkey IS NULL THEN 'failed' ELSE 'ok' END AS status FROM events e LEFT JOIN supplier s ON s.s_suppkey = e.user_id""")
def missing_is_failed(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), F.lit("ok").alias("status"))
    return read(spark, sf, "events").select("event_id", "user_id").join(s, "user_id", "left").select("event_id", F.coalesce("status", F.lit("failed")).alias("status"))


@query("WIN16", """
WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT user_id, round(max(value) FILTER (k <= 10), 6) AS peak, min(event_id) FILTER (k > 10 AND value < 10) AS knee FROM r GROUP BY 1""")
def knee(spark, sf):
    r = ordered.indexed(read(spark, sf, "events"), ["user_id"], ["event_id"], 10)
    return r.groupBy("user_id").agg(R(F.max(F.when(F.col("is_warmup"), F.col("value")))).alias("peak"), F.min(F.when(~F.col("is_warmup") & (F.col("value") < 10), F.col("event_id"))).alias("knee"))

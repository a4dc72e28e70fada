"""Windows of runs: exact or estimated starts, samples by as-of lookup, alignment. Survey ids stand in brackets.

Times are whole numbers of one unit. Long keys are dealt to cells of time, so no order runs over a whole key in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .stats import log_cell


def cell(at: Column | str, width: int) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / width).cast("long")


def quantiles_by(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys and, by name, the exact quantiles of the values that are not null, between the two nearest ranks in proportion.

    Values are counted first and dealt to cells of like size; totals of a key's cells, a bounded number, tell which hold the ranks asked
    for, and ranks run inside those alone.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("k_")).withColumn("c_", log_cell("v_"))
    of, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("c_").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.groupBy(*keys, "c_").agg(F.sum("k_").alias("s_"))
    cells = cells.select(*keys, "c_", F.coalesce(F.sum("s_").over(upto), F.lit(0)).alias("below_"), "s_", F.sum("s_").over(of).alias("n_"))
    place = {name: (F.col("n_") - 1) * q for name, q in at.items()}
    ranks = [r for p in place.values() for r in (F.floor(p), F.ceil(p))]
    hit = reduce(lambda a, b: a | b, ((F.col("below_") <= r) & (F.col("below_") + F.col("s_") > r) for r in ranks))
    inside = Window.partitionBy(*keys, "c_").orderBy("v_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.join(cells.filter(hit).drop("s_"), [*keys, "c_"]).withColumn("to_", F.col("below_") + F.sum("k_").over(inside))
    value_at = lambda rank: F.min(F.when(F.col("to_") > rank, F.col("v_")))
    n = F.max("n_")
    found = ranked.groupBy(*keys).agg(n.alias("n_"), *(value_at(f(p)).alias(f"{name}_{k}") for name, p in place.items() for k, f in enumerate((F.floor, F.ceil))))
    return found.select(*keys, *((F.col(f"{name}_0") + (F.col(f"{name}_1") - F.col(f"{name}_0")) * (p - F.floor(p))).alias(name) for name, p in place.items()))


def median_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, name: the exact median, the mean of the two middle values for an even count."""
    return quantiles_by(df, keys, value, {name: 0.5})


def previous_end(runs: DataFrame, keys: list[str], end: str, tie: str, width: int) -> DataFrame:
    """runs with prev_: the end of the run before by (end, tie), null for a key's first."""
    rows = runs.withColumn("c_", cell(end, width))
    own = F.lag(end).over(Window.partitionBy(*keys, "c_").orderBy(end, tie))
    cells = rows.groupBy(*keys, "c_").agg(F.max(end).alias("last_"))
    before = cells.select(*keys, "c_", F.lag("last_").over(Window.partitionBy(*keys).orderBy("c_")).alias("before_"))
    first = F.row_number().over(Window.partitionBy(*keys, "c_").orderBy(end, tie)) == 1
    rows = rows.withColumns({"own_": own, "first_": first}).join(before, [*keys, "c_"])
    return rows.withColumn("prev_", F.when(F.col("first_"), F.col("before_")).otherwise(F.col("own_"))).drop("c_", "own_", "first_", "before_")


def build_windows(runs: DataFrame, keys: list[str], fallback: int, width: int) -> DataFrame:
    """[WIN07, WIN08, WIN09] keys, run, source, setup_start, measure_start, end: windows of the runs of a session (keys), none reaching behind the end of the one before.

    runs: keys, run (unique in its session), end, and where known started, preflight, span (of the device's own stream; null
    for fewer than two stamps) and session_start. A run without a start begins its span before its end; without a span, or
    with one of zero, the median span of the session's runs before it, or `fallback` where none has one. Setup begins at
    preflight, else at the end of the run before. The first run's is the median of the other runs' setups, those over zero,
    before its measuring, not before session_start. Medians are rounded down. Then both starts are clamped to the end of the run before,
    setup to measuring, measuring to the run's end. Runs without an end have no window; order is by (end, run). Each pass reads
    what the one before has written.
    """
    rows = previous_end(runs.filter(F.col("end").isNotNull()), keys, "end", "run", width)
    span = F.when(F.col("started").isNotNull(), F.col("end") - F.col("started")).otherwise(F.col("span"))
    rows = cut(rows.withColumn("span_", span))
    rows = rows.join(median_by(rows, keys, "span_", "usual_"), keys, "left")
    guess = F.when(F.coalesce("span", F.lit(0)) == 0, F.floor(F.coalesce("usual_", F.lit(fallback)))).otherwise(F.col("span"))
    measure = F.coalesce("started", F.col("end") - guess)
    rows = cut(rows.withColumn("m_", measure).withColumn("s_", F.coalesce("preflight", "prev_", "m_")))
    setups = rows.withColumn("pad_", F.when(F.col("prev_").isNotNull() & (F.col("m_") > F.col("s_")), F.col("m_") - F.col("s_")))
    rows = rows.join(median_by(setups, keys, "pad_", "pad_"), keys, "left")
    first = F.col("m_") - F.floor(F.coalesce("pad_", F.lit(0)))
    opening = F.col("prev_").isNull() & F.col("preflight").isNull()
    rows = rows.withColumn("s_", F.when(opening, F.greatest(first, "session_start")).otherwise(F.col("s_")))
    # greatest and least pass over nulls
    rows = rows.withColumn("m_", F.greatest("m_", "prev_")).withColumn("s_", F.least(F.greatest("s_", "prev_"), "m_"))
    source = F.when(F.col("started").isNotNull(), "header").when(F.coalesce("span", F.lit(0)) > 0, "device").otherwise("median")
    return cut(rows.select(*keys, "run", source.alias("source"), F.col("s_").cast("long").alias("setup_start"), F.least("m_", "end").cast("long").alias("measure_start"), "end"))


def next_end(points: DataFrame, windows: DataFrame, keys: list[str], at: str, tie: str, width: int) -> DataFrame:
    """points with w_, the window (a struct: end, tie and the other columns) of their key that is first by (end, tie) of those that end at `at` or later; null if none.

    One sort of points and ends together inside (key, cell of time); where a cell has no later end, the next cell that has one
    gives its first. No pairs are made. A window without an end or a point without a time has no other side.
    """
    carried = [c for c in windows.columns if c not in (*keys, "end", tie)]
    ends = windows.filter(F.col("end").isNotNull()).select(*keys, F.col("end").alias("t_"), F.lit(1).alias("kind_"), F.struct("end", tie, *carried).alias("w_"))
    own = points.select(*keys, F.col(at).alias("t_"), F.lit(0).alias("kind_"), F.struct(*points.columns).alias("p_"))
    both = own.unionByName(ends, allowMissingColumns=True).withColumn("c_", cell("t_", width))
    onward = Window.partitionBy(*keys, "c_").orderBy("t_", "kind_", F.col(f"w_.{tie}")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.partitionBy(*keys).orderBy("c_").rowsBetween(1, Window.unboundedFollowing)
    cells = both.groupBy(*keys, "c_").agg(F.min("w_").alias("w_")).select(*keys, "c_", F.first("w_", ignorenulls=True).over(later).alias("later_"))
    found = both.withColumn("here_", F.first("w_", ignorenulls=True).over(onward)).filter("kind_ = 0")
    joined = found.join(cells.withColumnsRenamed({k: f"{k}_k" for k in keys}), [found[k].eqNullSafe(F.col(f"{k}_k")) for k in keys] + [found["c_"].eqNullSafe(cells["c_"])], "left")
    return joined.select("p_.*", F.when(F.col("t_").isNotNull(), F.coalesce("here_", "later_")).alias("w_"))


def assign(points: DataFrame, windows: DataFrame, keys: list[str], at: str, start: str, tie: str, width: int) -> DataFrame:
    """[JOI07] points with w_, the window they lie in (both ends belong to it), else null: at most one, the first by (end, tie) whose end is not before them.

    For windows that do not overlap, and for windows whose starts rise with their ends, that is the first of all they lie in.
    """
    found = next_end(points, windows, keys, at, tie, width)
    return found.withColumn("w_", F.when(F.col(f"w_.{start}") <= F.col(at), F.col("w_")))

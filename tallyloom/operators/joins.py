"""Joins that Spark has no operator for, and keyed merges. Survey ids stand in brackets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_pairs(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """[JOI03, JOI04, WIN03] All pairs of rows of a key, earlier left: keys, l_*, r_*, adjacent.

    The output is the square of a key's rows by definition, so keys are to be bounded groups (versions of one item).
    """
    ranked = df.withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    side = lambda p: ranked.select(*keys, F.col("k_").alias(p + "k_"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return side("l").join(side("r"), keys).filter("lk_ < rk_").withColumn("adjacent", F.col("rk_") == F.col("lk_") + 1).drop("lk_", "rk_")


def vector_delta(pairs: DataFrame, features: list[str], missing_zero: bool = False) -> DataFrame:
    """[JOI06, SCA10] d_<feature> = right - left; a missing side is 0 with missing_zero, else the difference is null."""
    side = (lambda c: F.coalesce(F.col(c), F.lit(0))) if missing_zero else F.col
    return pairs.withColumns({f"d_{f}": side(f"r_{f}") - side(f"l_{f}") for f in features})


def interval_join(points: DataFrame, windows: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """[JOI07] Points inside [start, end] of windows of their key, by an equi-join on (key, time cell) of the given width.

    A window enters every cell it touches; width near the windows' usual length keeps that few. No nested-loop join.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    cells = windows.filter(F.col(start) <= F.col(end)).withColumn("cell_", F.explode(F.sequence(cell(start), cell(end))))
    return points.withColumn("cell_", cell(at)).join(cells, [key, "cell_"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("cell_")


def first_window(joined: DataFrame, point: str, end: str, tie: str) -> DataFrame:
    """[JOI07] Of the windows a point lies in the first by end, then tie; so each point is in one at most."""
    return joined.withColumn("n_", F.row_number().over(Window.partitionBy(point).orderBy(end, tie))).filter("n_ = 1").drop("n_")


def nearest(joined: DataFrame, keys: list[str], at: str, target: str, tie: str) -> DataFrame:
    """[JOI08] Of the rows of each key the one whose time is nearest to the target; ties by time, then tie."""
    return joined.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs(F.col(at) - F.col(target)), at, tie))).filter("n_ = 1").drop("n_")


def precedence_merge(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """[JOI10, JOI11, JOI23, INC19, INC22] Rows of the first source that has a key; `source` is its number from 0."""
    tagged = [s.withColumn("source", F.lit(k)) for k, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = rows.groupBy(*keys).agg(F.min("source").alias("source"))
    return rows.join(best, [*keys, "source"])


def full_compare(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """[JOI16, JOI17, JOI18, JOI32] keys, status (added, missing, changed, same), and the names of fields that differ."""
    a = before.select(*keys, F.struct(*fields).alias("a_"))
    b = after.select(*keys, F.struct(*fields).alias("b_"))
    diff = F.array_compact(F.array(*[F.when(~F.col(f"a_.{f}").eqNullSafe(F.col(f"b_.{f}")), f) for f in fields]))
    status = F.when(F.col("a_").isNull(), "added").when(F.col("b_").isNull(), "missing").when(F.size(diff) > 0, "changed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"), F.when(status == "changed", diff).otherwise(F.array().cast("array<string>")).alias("fields"))


def work_list(candidates: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """[JOI19, JOI22, INC12] Candidates that no settled row has."""
    return candidates.join(settled.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, fresh: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """[SNK05, INC19, INC20] One row for each key, the newest of both; a fresh row wins a tie."""
    rows = table.withColumn("f_", F.lit(0)).unionByName(fresh.withColumn("f_", F.lit(1)))
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest, F.desc("f_")))).filter("n_ = 1").drop("n_", "f_")


def carry_forward(old: DataFrame, fresh: DataFrame, part: str) -> DataFrame:
    """[SNK13, INC21, SET10] Fresh rows, and old rows of the parts that fresh has none of."""
    return fresh.unionByName(work_list(old, fresh, [part]))

"""Operators over ordered rows. Every order is total by its parameters; survey ids stand in brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def schedule_position(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """[WIN01] pos = rank from 0 over the count, over all rows of the session, failed ones too."""
    w = Window.partitionBy(*keys)
    return df.withColumn("pos", (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w))


def indexed(df: DataFrame, keys: list[str], order: list[str], warmup: int) -> DataFrame:
    """[WIN02, FLT06, FLT17] idx from 0 and is_warmup; filter before, so the index is dense."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("is_warmup", F.col("idx") < warmup)


def trimmed_median(df: DataFrame, keys: list[str], order: list[str], value: str, warmup: int) -> DataFrame:
    """[AGG05] n_raw, n_used, warmup_dropped, median of what follows the warm-up; of all where nothing follows."""
    rows = indexed(df, keys, order, warmup)
    n, kept = F.count("*"), F.count_if(~F.col("is_warmup"))
    med = F.when(kept == 0, F.median(value)).otherwise(F.median(F.when(~F.col("is_warmup"), F.col(value))))
    return rows.groupBy(*keys).agg(n.alias("n_raw"), F.when(kept == 0, n).otherwise(kept).alias("n_used"), F.when(kept == 0, F.lit(0)).otherwise(n - kept).alias("warmup_dropped"), med.alias("median"))


def revisions(df: DataFrame, keys: list[str], order: list[str], digest: str) -> DataFrame:
    """[WIN05] status new or unchanged against the row before, and the running number of new ones as rev_NNN."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = df.withColumn("changed", (~F.col(digest).eqNullSafe(F.lag(digest).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    number = F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return new.withColumn("rev", F.concat(F.lit("rev_"), F.lpad(number.cast("string"), 3, "0"))).withColumn("status", F.when(F.col("changed") == 1, "new").otherwise("unchanged")).drop("changed")


def ordinal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """[WIN06] Position from 0 among rows of equal keys."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """[WIN04, WIN13, SRT10] The first row of each key."""
    return df.withColumn("first_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("first_ = 1").drop("first_")


def hysteresis(df: DataFrame, keys: list[str], order: list[str], value: str, on: float, off: float) -> DataFrame:
    """[WIN15] paused = 1 from a value at or over `on` until one at or under `off`; 0 before either."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col(value) >= on, 1).when(F.col(value) <= off, 0)
    return df.withColumn("paused", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)))


def stall(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """[WIN14] Time since the running maximum last rose, and that maximum."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = df.withColumn("top", F.max(value).over(w))
    was = F.lag("top").over(Window.partitionBy(*keys).orderBy(order))
    rose = top.withColumn("rose", F.when(was.isNull() | (F.col("top") > was), F.col(order)))
    return rose.withColumn("stalled", F.col(order) - F.last("rose", ignorenulls=True).over(w)).drop("rose")


def streaks(df: DataFrame, keys: list[str], order: list[str], flag: Column, member: str) -> DataFrame:
    """[WIN16, WIN17] Islands of consecutive rows with flag: keys, island, length, members (distinct), first and last order value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("f_", flag).withColumn("island", F.row_number().over(w) - F.sum(F.col("f_").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.filter("f_").groupBy(*keys, "island").agg(F.count("*").alias("length"), F.count_distinct(member).alias("members"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """[SRT06] Batch number of rows in order."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def half_holders(df: DataFrame, item: str, cost: str) -> DataFrame:
    """[AGG26] How few items hold half of the cost, over totals by item; median is the upper middle one. One row.

    Items are counted first and dealt to cells of like cost, 64 to a doubling. Totals of cells, a bounded number of rows,
    are summed in one task; ranks and running sums inside a cell in that cell's.
    """
    own = df.groupBy(item).agg(F.sum(cost).alias("c")).withColumn("cell_", F.when(F.col("c") > 0, F.floor(F.log2(F.col("c").cast("double")) * 64)).otherwise(F.lit(-1_000_000)))
    higher = Window.orderBy(F.desc("cell_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = own.groupBy("cell_").agg(F.sum("c").alias("s_"), F.count("*").alias("k_"))
    every = Window.partitionBy()
    cells = cells.select("cell_", (F.sum("s_").over(higher) - F.col("s_")).alias("before_"), (F.sum("k_").over(higher) - F.col("k_")).alias("above_"), F.sum("s_").over(every).alias("total"), F.sum("k_").over(every).alias("n"))
    w = Window.partitionBy("cell_").orderBy(F.desc("c"), item)
    rank, run = F.row_number().over(w), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = own.join(cells, "cell_").withColumns({"r": F.col("above_") + rank, "run": F.col("before_") + run})
    return ranked.agg(F.min(F.when(F.col("run") >= F.col("total") / 2, F.col("r"))).cast("long").alias("half_in"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("c"))).alias("upper_median"), F.max("c").alias("largest"))


def lowest_of_group(df: DataFrame, group: str, item: str, salts: int = 4096) -> DataFrame:
    """[WIN04, AGG24] item, lowest: the smallest item of each row's group. The group is worked out once, and a hot one is dealt out by salt."""
    dealt = df.groupBy(group, F.pmod(F.xxhash64(item), F.lit(salts)).alias("s_")).agg(F.min(item).alias("m_"), F.collect_list(item).alias("i_"))
    return dealt.withColumn("lowest", F.min("m_").over(Window.partitionBy(group))).select(F.explode("i_").alias(item), "lowest")

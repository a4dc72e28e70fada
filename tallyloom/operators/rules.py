"""Rules as data: firings, hard and soft sets, verdicts of groups and pairs. Survey ids stand in brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def firings(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """[R0-R22, RUL12] key, rules: the sorted names whose predicate holds. One pass, no shuffle; a null predicate does not fire."""
    fired = F.array_compact(F.array(*[F.when(p, name) for name, p in rules.items()]))
    return df.select(key, F.array_sort(fired).alias("rules"))


def hard_set(rules: list[str], soft: list[str], strict: bool = False, always: tuple[str, ...] = ()) -> list[str]:
    """[RUL01] Names that exclude: all but the soft ones, soft ones too when strict, and those that always do."""
    return sorted({r for r in rules if strict or r not in soft} | set(always))


def group_verdict(fired: DataFrame, hard: list[str], soft: list[str]) -> DataFrame:
    """[RUL02] Adds excluded_by, flagged_by, eligible."""
    names = lambda x: F.array(*[F.lit(n) for n in x]).cast("array<string>")
    by = F.array_sort(F.array_intersect("rules", names(hard)))
    return fired.withColumn("excluded_by", by).withColumn("flagged_by", F.array_sort(F.array_except(F.array_intersect("rules", names(soft)), names(hard)))).withColumn("eligible", F.size("excluded_by") == 0)


def pair_verdict(pairs: DataFrame, hard: list[str], zero: Column, form: Column, binding: Column) -> DataFrame:
    """[RUL03, SET04] pairs has l_rules, r_rules, group_rules: hard rules of either side and the group's own exclude first,
    then a zero difference (R15); of the survivors those whose form differs (R20), then those whose bindings differ (R13)."""
    names = F.array(*[F.lit(n) for n in hard]).cast("array<string>")
    fired = F.array_sort(F.array_union(F.array_intersect(F.array_union("l_rules", "r_rules"), names), F.col("group_rules")))
    one = lambda r: F.array(F.lit(r))
    rules = F.when(F.size("fired_") > 0, F.col("fired_")).when(zero, one("R15")).when(form, one("R20")).when(binding, one("R13")).otherwise(F.array().cast("array<string>"))
    return pairs.withColumn("fired_", fired).withColumn("verdict_rules", rules).withColumn("verdict", F.when(F.size("verdict_rules") > 0, "excluded").otherwise("eligible")).drop("fired_")


def rule_counts(df: DataFrame, rules: str = "rules") -> DataFrame:
    """[AGG11] rule, n over the exploded arrays."""
    return df.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def funnel(df: DataFrame, steps: dict[str, Column], distinct: list[str]) -> DataFrame:
    """[AGG15, AGG33, AGG34] step, rows and distinct values of some columns, one pass over the input for all steps."""
    flags = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(name).alias("step"), ok.alias("ok")) for k, (name, ok) in enumerate(steps.items())])
    rows = df.withColumn("s_", F.explode(F.filter(flags, lambda x: x["ok"])))
    return rows.groupBy(F.col("s_.step").alias("step")).agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct])


def gate(thermal: Column, level: Column, stop_at: int, floor: int, ceiling: float, pause: bool = True) -> Column:
    """[RUL17] cool over the thermal ceiling, then pause (or abort without pausing) under the floor, abort on no reading, else proceed."""
    return F.when(thermal > ceiling, "cool").when(level.isNull(), "abort").when(level <= stop_at, "pause" if pause else "abort").when(level < floor, "pause").otherwise("proceed")

"""Statistics as DataFrame operators: effect sizes, ranks, curves, agreement. Survey ids stand in brackets."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_cell(value: str) -> Column:
    """A cell of like values, 64 to a doubling of their size, in the values' order; a null value has none."""
    v = F.col(value).cast("double")
    return F.floor(F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * 64)).cast("long")


def below(counted: DataFrame, keys: list[str], value: str, sums: list[str], descending: bool = False, cell: Column | None = None) -> DataFrame:
    """counted with below_<c> and all_<c> for each of sums: its total over the rows of the keys with a smaller value (larger if descending), and over all.

    One row for each key and value comes in. Totals of cells, a bounded number for a key, are summed in order, and rows in order inside
    a cell alone, so a handful of keys with all rows is dealt to as many tasks as there are cells.
    """
    c = counted.withColumn("c_", log_cell(value) if cell is None else cell)
    order = F.desc if descending else F.asc
    before = (Window.unboundedPreceding, -1)
    per = c.groupBy(*keys, "c_").agg(*(F.sum(x).alias(x) for x in sums))
    across, whole = Window.partitionBy(*keys).orderBy(order("c_")).rowsBetween(*before), Window.partitionBy(*keys)
    per = per.select(*(F.col(k).alias(f"k_{k}") for k in keys), F.col("c_").alias("of_cell_"), *(F.coalesce(F.sum(x).over(across), F.lit(0)).alias(f"cells_{x}") for x in sums), *(F.sum(x).over(whole).alias(f"all_{x}") for x in sums))
    inside = Window.partitionBy(*keys, "c_").orderBy(order(value)).rowsBetween(*before)
    same = [c[k].eqNullSafe(per[f"k_{k}"]) for k in keys] + [c["c_"].eqNullSafe(per["of_cell_"])]
    placed = c.withColumns({f"own_{x}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums}).join(per, same)
    return placed.select(*counted.columns, *((F.col(f"cells_{x}") + F.col(f"own_{x}")).alias(f"below_{x}") for x in sums), *(f"all_{x}" for x in sums))


def cliffs_delta(df: DataFrame, keys: list[str], arm: str, value: str) -> DataFrame:
    """[AGG08] keys, n0, n1, delta = mean sign(right - left) by mid-ranks, O(n log n). arm is 0 (left) or 1 (right).

    A group without one arm has a null delta. Values are first counted, so the ordered pass sees distinct values only.
    """
    counts = df.groupBy(*keys, value).agg(F.count_if(F.col(arm) == 0).alias("c0"), F.count_if(F.col(arm) == 1).alias("c1"))
    placed = below(counts, keys, value, ["c0"])
    u = F.sum(F.col("c1") * (F.col("below_c0") + F.col("c0") / 2))
    n0, n1 = F.sum("c0"), F.sum("c1")
    delta = F.when((n0 > 0) & (n1 > 0), 2 * u / (n0 * n1) - 1)
    return placed.groupBy(*keys).agg(n0.alias("n0"), n1.alias("n1"), delta.alias("delta"))


def effect_band(delta: Column) -> Column:
    """[SCA11] negligible below 0.147, small to 0.33, medium to 0.474, large."""
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d <= 0.33, "small").when(d < 0.474, "medium").when(d.isNotNull(), "large")


def effective_number(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """[AGG03, AGG04] keys, items, top_share, effective = 1 / sum of squared shares."""
    counts = df.groupBy(*keys, item).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.groupBy(*keys).agg(F.count("*").alias("items"), (F.max("n") / total).alias("top_share"), (total * total / F.sum(F.col("n") * F.col("n"))).alias("effective"))


def drift_slope(df: DataFrame, group: str, role: str, pos: str, value: str) -> DataFrame:
    """[WIN10] group, n, slope of value on pos with an intercept for each role (Frisch-Waugh); 0 where pos is constant in every role."""
    inside = Window.partitionBy(group, role)
    x, y = F.col(pos) - F.avg(pos).over(inside), F.col(value) - F.avg(value).over(inside)
    sums = df.select(group, x.alias("x"), y.alias("y")).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    return sums.select(group, "n", F.when(F.col("xx") > 1e-12, F.col("xy") / F.col("xx")).otherwise(0.0).alias("slope"))


def score_steps(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """[MLE04, MLE05, WIN11, WIN12, WIN20] One row for each distinct score, highest first, with counts so far: the basis of all curves."""
    steps = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("m"))
    placed = below(steps, keys, score, ["p", "m"], descending=True)
    return placed.select(*keys, score, "p", "m", (F.col("below_p") + F.col("p")).alias("tp"), (F.col("below_m") + F.col("m")).alias("seen"), F.col("all_p").alias("pos"), F.col("all_m").alias("n"))


def rank_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """[AGG31] keys, rho: Spearman's correlation by mid-ranks. Ranks are worked out on counted values; a null value ranks before all others."""

    def ranked(c: str) -> DataFrame:
        counted = df.groupBy(*keys, c).agg(F.count("*").alias("n_"))
        r = below(counted, keys, c, ["n_"], cell=F.coalesce(log_cell(c), F.lit(-(1 << 40))))
        return r.select(*(F.col(k).alias(f"{c}_{k}") for k in keys), F.col(c).alias(f"{c}_v"), (F.col("below_n_") + (F.col("n_") + 1) / 2).alias(f"{c}_r"))

    pairs = df.groupBy(*keys, a, b).agg(F.count("*").alias("w_"))
    for c in (a, b):
        r = ranked(c)
        pairs = pairs.join(r, [pairs[k].eqNullSafe(r[f"{c}_{k}"]) for k in keys] + [pairs[c].eqNullSafe(r[f"{c}_v"])])
    w, x, y = F.col("w_"), F.col(f"{a}_r"), F.col(f"{b}_r")
    sums = pairs.groupBy(*keys).agg(F.sum(w).alias("n"), *(F.sum(w * e).alias(n) for n, e in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))))
    n, var = F.col("n"), lambda c: F.col(c * 2) - F.col(c) * F.col(c) / F.col("n")
    return sums.select(*keys, F.when((var("x") > 0) & (var("y") > 0), (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(var("x") * var("y"))).alias("rho"))


def ranking_metrics(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """[MLE04, MLE05, WIN20] keys, n, positives, auc (ties count half), average_precision (step sum)."""
    s = score_steps(df, keys, score, label)
    neg, fp = F.col("m") - F.col("p"), F.col("seen") - F.col("tp")
    wins = F.sum(neg * (F.col("tp") - F.col("p") + F.col("p") / 2))
    pos, n = F.max("pos"), F.max("n")
    auc = F.when((pos > 0) & (pos < n), wins / (pos * (n - pos)))
    ap = F.when(pos > 0, F.sum(F.col("p") * F.col("tp") / (F.col("tp") + fp)) / pos)
    return s.groupBy(*keys).agg(n.alias("n"), pos.alias("positives"), auc.alias("auc"), ap.alias("average_precision"))


def confusion(df: DataFrame, keys: list[str], predicted: str, label: str) -> DataFrame:
    """[MLE06] tp, fp, fn, tn, precision, recall, specificity, balanced_accuracy, f1, mcc; null where a denominator is zero."""
    p, y = F.col(predicted), F.col(label)
    c = df.groupBy(*keys).agg(*[F.count_if((p == a) & (y == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))])
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b != 0, a / b)
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2, "f1": ratio(2 * tp, 2 * tp + fp + fn), "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})


def kappa(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """[MLE21] Cohen's kappa of two 0/1 labels."""
    n, x, y = F.count("*"), F.avg(a), F.avg(b)
    same = F.avg((F.col(a) == F.col(b)).cast("double"))
    chance = x * y + (1 - x) * (1 - y)
    return df.groupBy(*keys).agg(n.alias("n"), F.when(chance < 1, (same - chance) / (1 - chance)).alias("kappa"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """[MLE22] Normalised mutual information of two columns, arithmetic mean of entropies, natural logarithm; one row.

    The contingency table is counted before any total, so totals see distinct pairs only.
    """
    cells = df.groupBy(a, b).agg(F.count("*").alias("c"))
    rows, cols = cells.groupBy(a).agg(F.sum("c").alias("r")), cells.groupBy(b).agg(F.sum("c").alias("k"))
    n = cells.agg(F.sum("c").alias("n"))
    entropy = lambda t, x: t.crossJoin(F.broadcast(n)).agg((-F.sum(F.col(x) / F.col("n") * F.log(F.col(x) / F.col("n")))).alias("h" + x))
    joint = cells.join(rows, a).join(cols, b).crossJoin(F.broadcast(n))
    mi = joint.agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("r") * F.col("k")))).alias("mi"))
    both = mi.crossJoin(entropy(rows, "r")).crossJoin(entropy(cols, "k"))
    return both.select("mi", F.when(F.col("hr") + F.col("hk") > 0, 2 * F.col("mi") / (F.col("hr") + F.col("hk"))).alias("nmi"))


#: Cells of [0, 1] that p-values are dealt to.
CELLS = 1024


def bh_qvalues(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """[WIN18] Benjamini-Hochberg q: the least p * m / rank of this and all larger p; a null p has none.

    Equal p are counted first. Counts below and least values above come in two levels, over cells of p and inside a cell,
    so a key with most of all rows is dealt to CELLS tasks, and each pass is linear.
    """
    counts = df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("c_")).withColumn("cell_", F.floor(F.col(p) * CELLS))
    inside = Window.partitionBy(*keys, "cell_")
    cells = Window.partitionBy(*keys)
    up = (Window.unboundedPreceding, Window.currentRow)
    below = counts.groupBy(*keys, "cell_").agg(F.sum("c_").alias("n_"))
    below = below.select(*keys, "cell_", (F.sum("n_").over(cells.orderBy("cell_").rowsBetween(*up)) - F.col("n_")).alias("below_"), F.sum("n_").over(cells).alias("m_"))
    rank = F.col("below_") + F.sum("c_").over(inside.orderBy(p).rowsBetween(*up))
    valued = counts.join(below, [*keys, "cell_"]).withColumn("v_", F.col(p) * F.col("m_") / rank)
    above = valued.groupBy(*keys, "cell_").agg(F.min("v_").alias("least_"))
    above = above.select(*keys, "cell_", F.min("least_").over(cells.orderBy(F.desc("cell_")).rowsBetween(Window.unboundedPreceding, -1)).alias("above_"))
    least = F.min("v_").over(inside.orderBy(F.desc(p)).rowsBetween(*up))
    q = valued.withColumn("q", least).join(above, [*keys, "cell_"]).select(*keys, p, F.least(F.lit(1.0), "q", "above_").alias("q"))
    return df.join(q, [*keys, p], "left")


def jackknife(df: DataFrame, group: str, hit: str) -> DataFrame:
    """[MLE12] Share of hits without each group: totals minus the group's own sums."""
    own = df.groupBy(group).agg(F.sum(F.col(hit).cast("long")).alias("a"), F.count("*").alias("t"))
    total = own.agg(F.sum("a").alias("sa"), F.sum("t").alias("st"))
    rest = F.col("st") - F.col("t")
    return own.crossJoin(F.broadcast(total)).select(group, F.col("t").alias("left_out"), F.when(rest > 0, (F.col("sa") - F.col("a")) / rest).alias("share_without"))


def ceiling(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """[AGG31, AGG32] Vectors, vectors with both labels, and the best accuracy any function of the features can have; one row."""
    v = df.groupBy(*features).agg(F.count("*").alias("m"), F.sum(F.col(label).cast("long")).alias("p"))
    return v.agg(F.count("*").alias("vectors"), F.count_if((F.col("p") > 0) & (F.col("p") < F.col("m"))).alias("conflicting"), (F.sum(F.greatest("p", F.col("m") - F.col("p"))) / F.sum("m")).alias("ceiling"))


def any_moves(columns: list[str]) -> Column:
    """[FLT03] Whether any of the columns is not zero."""
    return reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns])


def inflation_factors(df: DataFrame, features: list[str]) -> DataFrame:
    """[AGG31] feature, vif: the diagonal of the inverse of the correlation matrix. One aggregate; the matrix has one row for each feature."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i)]
    row = df.agg(*[F.corr(features[i], features[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    r = np.eye(len(features))
    for i, j in pairs:
        r[i, j] = r[j, i] = row[f"r{i}_{j}"]
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, np.diag(np.linalg.inv(r)), strict=True)], "feature string, vif double")


def restriction_funnel(df: DataFrame, steps: list[tuple[str, Column]], group: str, label: str, vector: list[str]) -> DataFrame:
    """[AGG34] step, name, n, groups, prevalence, majority, ceiling of the rows that meet all conditions up to each step.

    majority is the better constant answer, ceiling the best that any rule on `vector` could reach. A row is counted once for each step it
    reaches; counts by vector come first, so no step meets in one task but as those.
    """
    reached = [F.lit(True)]
    for _, c in steps:
        reached.append(reached[-1] & F.coalesce(c, F.lit(False)))
    names = F.array(*(F.when(r, F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"))) for k, (r, (n, _)) in enumerate(zip(reached[1:], steps, strict=True))))
    rows = df.select(group, F.col(label).cast("long").alias("y_"), *vector, F.explode(F.array_compact(names)).alias("s_")).select("s_.*", group, "y_", *vector)
    cells = rows.groupBy("step", "name", *vector).agg(F.count("*").alias("n"), F.sum("y_").alias("p"))
    out = cells.groupBy("step", "name").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.greatest("p", F.col("n") - F.col("p"))).alias("best"))
    groups = rows.select("step", group).distinct().groupBy("step").agg(F.count(group).alias("groups"))
    share = F.col("p") / F.col("n")
    return out.join(groups, "step").select("step", "name", "n", "groups", share.alias("prevalence"), F.greatest(share, 1 - share).alias("majority"), (F.col("best") / F.col("n")).alias("ceiling"))

"""Learners as tables: forests as flat arrays, their inference, permutation tests, ablations. Survey ids stand in brackets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

TREE = "struct<feature: array<int>, threshold: array<double>, left: array<int>, right: array<int>, p: array<double>>"


def tree_arrays(model) -> list[dict]:
    """[SNK18, SNK20] A fitted forest of pyspark.ml as flat arrays, one dict a tree; leaves have feature -1 and p, the share of class 1."""
    out = []
    for tree in model.trees:
        rows = {k: [] for k in ("feature", "threshold", "left", "right", "p")}

        def walk(node) -> int:
            at = len(rows["p"])
            stats = list(node.impurityStats().stats())
            for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("p", stats[1] / max(sum(stats), 1e-300))):
                rows[k].append(v)
            if node.subtreeDepth() > 0:
                rows["feature"][at], rows["threshold"][at] = node.split().featureIndex(), node.split().threshold()
                rows["left"][at] = walk(node.leftChild())
                rows["right"][at] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        out.append(rows)
    return out


def score_forest(df: DataFrame, trees: list[dict], features: str, keep: list[str]) -> DataFrame:
    """[MLE29] keep columns and score: mean p over trees; a row goes left where x <= threshold. Vectorised by level, no loop over rows."""
    packed = [{k: np.array(v) for k, v in t.items()} for t in trees]

    def run(batches):
        for b in batches:
            x = np.stack(b[features].to_numpy()) if len(b) else np.empty((0, 1))
            total = np.zeros(len(b))
            for t in packed:
                at = np.zeros(len(b), np.int64)
                while len(on := np.flatnonzero(t["feature"][at] >= 0)):
                    node = at[on]
                    at[on] = np.where(x[on, t["feature"][node]] <= t["threshold"][node], t["left"][node], t["right"][node])
                total += t["p"][at]
            yield b[keep].assign(score=total / max(1, len(packed)))

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, features).mapInPandas(run, f"{kinds}, score double")


def leave_one_out_bayes(df: DataFrame, keys: list[str], group: str, features: list[str], label: str) -> DataFrame:
    """[MLE10, MLE11] keys, group, n, hits: rows of each group that a naive Bayes learner, trained on all other groups, classes right.

    Counts of 0/1 features by label are sums, so training without a group is all sums less its own: one aggregation for
    every model, then one pass that scores the rows. Counts are smoothed by one; a tie is class 0.
    """
    return _bayes(_bayes_cells(df, keys, group, features, label), keys, group, features)


def _bayes_cells(df: DataFrame, keys: list[str], group: str, features: list[str], label: str) -> DataFrame:
    """keys, group, x_<feature>, y_, rows_: rows that the learner cannot tell apart, counted."""
    return df.groupBy(*keys, group, *[F.col(f).alias(f"x_{f}") for f in features], F.col(label).cast("int").alias("y_")).agg(F.count("*").alias("rows_"))


def _bayes(cells: DataFrame, keys: list[str], group: str, features: list[str]) -> DataFrame:
    y, of = F.col("y_"), F.col("rows_")
    sums = [F.sum(F.when(y == c, of).otherwise(0)).alias(f"n{c}") for c in (0, 1)] + [F.sum(F.when(y == c, F.col(f"x_{f}") * of).otherwise(0)).alias(f"{f}_{c}") for f in features for c in (0, 1)]
    own = cells.groupBy(*keys, group).agg(*sums)
    names = [c for c in own.columns if c not in (*keys, group)]
    every = own.groupBy(*keys).agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    rest = (own.join(every, keys) if keys else own.crossJoin(F.broadcast(every))).select(*keys, group, *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in names])
    p = lambda f, c: (F.col(f"{f}_{c}") + 1) / (F.col(f"n{c}") + 2)
    score = F.log((F.col("n1") + 1) / (F.col("n0") + 1))
    for f in features:
        score = score + F.when(F.col(f"x_{f}") == 1, F.log(p(f, 1) / p(f, 0))).otherwise(F.log((1 - p(f, 1)) / (1 - p(f, 0))))
    hit = (score > 0).cast("int") == y
    return cells.join(rest, [*keys, group]).groupBy(*keys, group).agg(F.sum("rows_").alias("n"), F.sum(F.when(hit, of).otherwise(0)).alias("hits"))


def shuffled_labels(df: DataFrame, item: str, label: str, draws: int, seed: int) -> DataFrame:
    """[MLE26] df once for each draw from 1, its labels dealt to other rows by two orders of hashes; draw 0 is df itself.

    Orders are ranks inside ranges of the hash, whose sizes are counted first, so a draw is dealt to many tasks.
    """
    at = lambda salt: F.pmod(F.xxhash64("draw", F.lit(f"{seed}{salt}"), item), F.lit(1 << 40))
    many = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))

    def ranked(salt: str) -> DataFrame:
        rows = many.withColumn("h_", at(salt)).withColumn("cell_", F.shiftright("h_", 34))
        before = Window.partitionBy("draw").orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
        below = rows.groupBy("draw", "cell_").count().select("draw", "cell_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below_"))
        own = F.row_number().over(Window.partitionBy("draw", "cell_").orderBy("h_", item))
        return rows.withColumn("k_", own).join(below, ["draw", "cell_"]).withColumn("r_", F.col("below_") + F.col("k_"))

    given = ranked("b").select("draw", "r_", F.col(label).alias("new_"))
    moved = ranked("a").join(given, ["draw", "r_"]).select(*[F.col("new_").alias(c) if c == label else F.col(c) for c in df.columns], "draw")
    return df.withColumn("draw", F.lit(0)).unionByName(moved)


def permutation_test(df: DataFrame, item: str, group: str, features: list[str], label: str, draws: int, seed: int) -> DataFrame:
    """[MLE26] observed, chance (mean over draws), p_value, draws: the share of right answers of the whole leave-one-out procedure against shuffled labels."""
    # rows are dealt once; every draw is kept as the counts of its cells
    many = shuffled_labels(df.select(item, group, *features, label), item, label, draws, seed)
    s = _bayes(stored(_bayes_cells(many, ["draw"], group, features, label)), ["draw"], group, features)
    share = s.groupBy("draw").agg((F.sum("hits") / F.sum("n")).alias("share"))
    seen = share.filter("draw = 0").select(F.col("share").alias("observed"))
    null = share.filter("draw > 0").crossJoin(F.broadcast(seen))
    return null.groupBy("observed").agg(F.avg("share").alias("chance"), ((1 + F.count_if(F.col("share") >= F.col("observed"))) / (1 + F.count("*"))).alias("p_value"), F.count("*").alias("draws"))

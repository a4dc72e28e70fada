"""Bootstraps and exact binomial tests. Draws are a table, so they spread like rows. Survey ids stand in brackets."""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_bootstrap(df: DataFrame, group: str, hits: Column, total: Column, draws: int, seed: int) -> DataFrame:
    """[MLE07] draw, share: whole groups drawn with replacement.

    Each group's sums are taken first; each (draw, group) has a Poisson(1) weight from a hash, the usual approximation of
    a multinomial over many groups. Rows are draws times groups, bounded by the number of groups, and are summed by draw.
    """
    own = df.groupBy(group).agg(hits.alias("a"), total.alias("t"))
    weighted = own.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", poisson(seed, "draw", group))
    return weighted.groupBy("draw").agg((F.sum(F.col("a") * F.col("w")) / F.nullif(F.sum(F.col("t") * F.col("w")), F.lit(0))).alias("share"))


#: P(X <= k) of a Poisson(1) number, k from 0.
POISSON = [math.exp(-1) * math.fsum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def poisson(seed: int, *by) -> Column:
    """A Poisson(1) number of 52 bits of a digest of columns."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in by]))
    return poisson_of(F.substring(digest, 1, 13))


def poisson_of(digits: Column) -> Column:
    """The number that 13 hexadecimal digits h stand for: how many of POISSON are at most (h + 0.5) / 2^52, compared as digits."""
    least = [f"{math.ceil(Fraction(c) * (1 << 52) - Fraction(1, 2)):013x}" for c in POISSON]
    out = F.when(digits < least[0], 0)
    for k, x in enumerate(least[1:], 1):
        out = out.when(digits < x, k)
    return out.otherwise(len(least))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows over all cores before they are multiplied: few rows would otherwise come as one partition."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(*by))


def two_stage_bootstrap(df: DataFrame, outer: str, inner: str, hits: Column, total: Column, draws: int, seed: int) -> DataFrame:
    """[MLE08] draw, share: outer clusters drawn with replacement, then, for each time one is drawn, its inner clusters.

    Weights are Poisson numbers of hashes as in group_bootstrap; an inner cluster adds one for each time its outer one came.
    """
    own = dealt(df.groupBy(outer, inner).agg(hits.alias("a"), total.alias("t")), outer, inner)
    # an outer cluster's draws are worked out once and kept as one list beside it
    came = df.select(outer).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("o_", poisson(seed, "draw", outer))
    lists = came.groupBy(outer).agg(F.flatten(F.collect_list(F.transform(F.slice(F.lit(list(range(1, len(POISSON) + 1))), F.lit(1), F.col("o_")), lambda k: F.struct("draw", k.alias("k_"))))).alias("c_"))
    times = own.join(lists.withColumnRenamed(outer, "outer_"), F.col(outer).eqNullSafe(F.col("outer_"))).select(outer, inner, "a", "t", F.explode("c_").alias("c_")).select("*", "c_.draw", "c_.k_")
    drawn = times.select("draw", "a", "t", poisson(seed + 1, "draw", outer, inner, "k_").alias("w"))
    return drawn.groupBy("draw").agg((F.sum(F.col("a") * F.col("w")) / F.nullif(F.sum(F.col("t") * F.col("w")), F.lit(0))).alias("share"))


def percentile_interval(draws: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """[MLE07] low, high, draws used; draws without a value are left out."""
    q = F.percentile(value, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return draws.agg(q[0].alias("low"), q[1].alias("high"), F.count(value).alias("used"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """[SCA12] P(X >= k), the regularised incomplete beta function of p at (k, n - k + 1), by its continued fraction.

    The fraction takes some dozens of steps around its middle for any n, in place of a sum over n terms.
    """
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    a, b = k, n - k + 1
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p))
    # the fraction converges fast on the side of the mean; the other side is its complement
    return front * _fraction(p, a, b) / a if p < (a + 1) / (a + b + 2) else 1 - front * _fraction(1 - p, b, a) / b


def _fraction(x: float, a: float, b: float, steps: int = 100_000, close: float = 1e-15) -> float:
    """The continued fraction of the incomplete beta function, evaluated forwards by ratios of convergents."""
    tiny = 1e-300
    over, under = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = under
    for m in range(1, steps):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            under, over = 1 / (1 + term * under or tiny), 1 + term / over or tiny
            value *= under * over
        if abs(under * over - 1) < close:
            break
    return value


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """[SCA12] Exact interval by bisection."""
    a = (1 - level) / 2

    def solve(f) -> float:
        lo, hi = 1e-12, 1 - 1e-12
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: binomial_tail(k, n, p) < a)
    high = 1.0 if k == n else solve(lambda p: 1 - binomial_tail(k + 1, n, p) > a)
    return low, high


def exact_intervals(df: DataFrame, key: str, hits: str, total: str) -> DataFrame:
    """[SCA12, MLE24] key, hits, total, p_value against one half, low, high, for aggregated rows."""

    def run(batches):
        for b in batches:
            k, n = b[hits].astype(int), b[total].astype(int)
            ci = [clopper_pearson(x, y) for x, y in zip(k, n, strict=True)]
            yield pd.DataFrame({key: b[key], hits: k, total: n, "p_value": [binomial_tail(x, y, 0.5) for x, y in zip(k, n, strict=True)], "low": [c[0] for c in ci], "high": [c[1] for c in ci]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, hits, total).mapInPandas(run, f"{key} {kind}, {hits} long, {total} long, p_value double, low double, high double")


#: Distinct values of a key that are worked on together, cells of a key at most, counts held at a time.
VALUES, CELLS, HELD = 512, 256, 1_000_000


def pair_bootstrap(df: DataFrame, key: str, arm: str, value: str, draws: int, seed: int) -> DataFrame:
    """[MLE09] key, delta, low, high: rows of each arm drawn with replacement, generators seeded by (seed, crc32(key), arm, place).

    A draw is a multinomial number of each distinct value. Values are counted and cut into cells; a draw's size falls to cells by
    binomial numbers down a tree of them, whose nodes have their own seeds, and inside a cell to its values. So a large key is
    dealt to many tasks; only sums by cell and draw, at most CELLS a key, meet in one group.
    """
    v = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    of = lambda n: F.count_if(F.col(arm) == n)
    counts = df.groupBy(F.col(key).alias("key_"), v.alias("v_")).agg(of(0).alias("l_"), of(1).alias("r_"))
    at = [k / CELLS for k in range(1, CELLS)]
    cuts = counts.groupBy("key_").agg(F.percentile_approx("v_", at, 10_000).alias("cuts_"), F.least(F.lit(CELLS), F.ceil(F.count("*") / VALUES)).alias("many_"))
    place = F.size(F.filter("cuts_", lambda x: x < F.col("v_"))) * F.col("many_")
    celled = counts.join(cuts.withColumnRenamed("key_", "own_"), F.col("key_").eqNullSafe(F.col("own_"))).withColumn("cell_", F.floor(place / CELLS).cast("int"))
    cells = celled.groupBy("key_", "cell_").agg(F.array_sort(F.collect_list(F.struct("v_", "l_", "r_"))).alias("of_"), F.sum("l_").alias("l_"), F.sum("r_").alias("r_"))
    sizes = cells.groupBy(F.col("key_").alias("own_")).agg(F.array_sort(F.collect_list(F.struct("cell_", "l_", "r_"))).alias("sizes_"))
    whole = cells.join(sizes, F.col("key_").eqNullSafe(F.col("own_"))).select("key_", "cell_", F.col("of_.l_").alias("l_"), F.col("of_.r_").alias("r_"), "sizes_")

    def sums(batches):
        for b in (one.slice(i, 1) for one in batches for i in range(one.num_rows)):
            r = b.to_pylist()[0]
            out = _cell_sums(zlib.crc32(str(r["key_"]).encode()), [s["cell_"] for s in r["sizes_"]].index(r["cell_"]), [(r["l_"], [s["l_"] for s in r["sizes_"]]), (r["r_"], [s["r_"] for s in r["sizes_"]])], draws, seed)
            yield pa.RecordBatch.from_arrays([b.column("key_"), b.column("cell_"), *(pa.array([s.tobytes()], pa.binary()) for s in out)], ["key", "cell", "l", "r", "inside"])

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("cell")
        l, r, inside = (np.stack([np.frombuffer(s) for s in group[c].to_pylist()]) for c in ("l", "r", "inside"))  # noqa: E741
        n, d = l[:, 0].sum() * r[:, 0].sum(), None
        if n:
            d = (inside + l * (r.sum(axis=0) - 2 * r.cumsum(axis=0) + r)).sum(axis=0) / n
        found = [None] * 3 if d is None else [d[0], np.quantile(d[1:], 0.025), np.quantile(d[1:], 0.975)]
        return pa.table([group["key"].slice(0, 1), *(pa.array([x], pa.float64()) for x in found)], [key, "delta", "low", "high"])

    kind = df.schema[key].dataType.simpleString()
    parts = dealt(whole, "key_", "cell_").mapInArrow(sums, f"key {kind}, cell int, l binary, r binary, inside binary")
    return parts.groupBy("key").applyInArrow(one, f"{key} {kind}, delta double, low double, high double")


def _cell_sums(crc: int, mine: int, arms: list[tuple[list[int], list[int]]], draws: int, seed: int) -> list[np.ndarray]:
    """Rows of the left arm, of the right one, and pairs inside the cell where the right is larger less those where it is smaller: as observed, then by draw."""
    drawn, share = [], []
    for arm, (own, cells) in enumerate(arms):
        upto = np.concatenate([[0], np.cumsum(cells)])
        n, lo, hi = np.full(draws, upto[-1]), 0, len(cells)
        while hi - lo > 1:
            mid, all_ = (lo + hi) // 2, upto[hi] - upto[lo]
            left = np.random.default_rng([seed, crc, arm, lo, hi]).binomial(n, (upto[mid] - upto[lo]) / all_ if all_ else 0)
            n, lo, hi = (left, lo, mid) if mine < mid else (n - left, mid, hi)
        drawn.append(n)
        share.append(np.array(own) / max(sum(own), 1))
    rng = [np.random.default_rng([seed, crc, arm, mine, mine, 1]) for arm in (0, 1)]

    def inside(l, r):  # noqa: E741
        return (l * (r.sum(axis=1, keepdims=True) - 2 * r.cumsum(axis=1) + r)).sum(axis=1)

    seen = [np.array([own]) for own, _ in arms]
    pairs, step = [inside(*seen)], max(1, HELD // len(share[0]))
    for i in range(0, draws, step):
        # an arm without rows here draws none
        pairs.append(inside(*(g.multinomial(n[i : i + step], s / s.sum()) if s.any() else np.zeros((len(n[i : i + step]), len(s)), np.int64) for g, n, s in zip(rng, drawn, share, strict=True))))
    return [*(np.concatenate([s.sum(axis=1), n]).astype(float) for s, n in zip(seen, drawn, strict=True)), np.concatenate(pairs).astype(float)]

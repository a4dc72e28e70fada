"""Nested group-disjoint validation: all models of a learner fitted together from sums over rows. Survey ids stand in brackets.

A training set is (o, i): rows outside outer fold o and, for i below `inner`, outside inner fold i of that split; i = inner is the
set on which the chosen model is fitted again. Every set and every point of the grid is one more key of the same sums, so a step
of all models is one pass over the rows. Sums, parameters and trees have a size that folds and grids set, not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .stats import ranking_metrics

#: Bins of a feature in trees; accuracy of the quantile sketches; tasks that add up sums.
BINS, ACCURACY, ADDERS = 16, 10_000, 8
#: Trees that the rows of a batch meet at a time, and rows that meet all trees: what a worker holds does not grow with a full batch.
TREES, PIECE = 25, 1024


@dataclass(frozen=True)
class Design:
    outer: int
    inner: int

    def sets(self) -> list[tuple[int, int]]:
        return [(o, i) for o in range(self.outer) for i in range(self.inner + 1)]

    def at(self, o: int, i: int) -> int:
        return o * (self.inner + 1) + i


@dataclass(frozen=True)
class Rows:
    """Rows of a batch as arrays."""

    id: np.ndarray
    hash: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    held: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(b: pa.RecordBatch) -> Rows:
        n = b.num_rows
        flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        return Rows(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "hash", "y", "fold")), flat("held"), flat("x"))

    def trains(self, d: Design, o: int, i: int) -> np.ndarray:
        return (self.fold != o) & ((i == d.inner) | (self.held[:, o] != i))


def prepared(df: DataFrame, item: str, group: str, label: str, fold: str, features: list[Column], design: Design, seed: int) -> DataFrame:
    """[MLE02] The written table that fits read: id, hash, y, fold, held (the row's inner fold in each outer split) and x.

    fold comes with the rows and is one of the group's; inner folds are drawn from the group's digest. Rows with a null label,
    fold, group or feature take no part.
    """
    held = F.array(*(F.pmod(F.xxhash64(F.lit(seed + o), group), F.lit(design.inner)).cast("int") for o in range(design.outer)))
    x = F.array(*(f.cast("double") for f in features))
    rows = df.select(F.col(item).alias("id"), F.xxhash64(F.lit(seed), item).alias("hash"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), F.when(F.col(group).isNotNull(), held).alias("held"), x.alias("x"))
    return cut(rows.filter(F.col("y").isNotNull() & F.col("fold").isNotNull() & F.col("held").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))))


def straddling(df: DataFrame, group: str, fold: str) -> DataFrame:
    """[MLE03] Groups with rows in more than one fold."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).filter("folds > 1")


@dataclass(frozen=True)
class Scales:
    """For each set: center and scale of each feature, whether it varies, the balanced weight of each class, the variance of scaled entries, edges of bins."""

    center: np.ndarray
    scale: np.ndarray
    keep: np.ndarray
    weight: np.ndarray
    variance: np.ndarray
    edges: np.ndarray

    def scaled(self, t: int, x: np.ndarray) -> np.ndarray:
        """[MLE01] Robust scaling; a feature that is constant in the set is 0 everywhere."""
        return (x - self.center[t]) / self.scale[t] * self.keep[t]


def scales(rows: DataFrame, design: Design) -> Scales:
    """[MLE01] One aggregate over all sets: medians, quartile ranges (1 where zero) and bin edges from quantile sketches, exact up to their accuracy; class weights n / (2 n_class)."""
    within = [F.when((F.col("fold") != o) & (F.lit(True) if i == design.inner else F.col("held")[o] != i), design.at(o, i)) for o, i in design.sets()]
    d = len(rows.first()["x"])
    at = [0.25, 0.5, 0.75, *(k / BINS for k in range(1, BINS))]
    each = rows.select("y", "x", F.explode(F.array_compact(F.array(*within))).alias("t"))
    per = [f(F.col("x")[j]) for j in range(d) for f in (lambda c: F.percentile_approx(c, at, ACCURACY), F.avg, F.var_pop)]
    found = each.groupBy("t").agg(F.count("*").alias("n"), F.sum("y").alias("p"), *(c.alias(f"c{k}") for k, c in enumerate(per))).collect()
    s = len(design.sets())
    out = Scales(np.zeros((s, d)), np.ones((s, d)), np.zeros((s, d)), np.ones((s, 2)), np.ones(s), np.zeros((s, d, BINS - 1)))
    for r in found:
        t, mean, square = r["t"], np.zeros(d), np.zeros(d)
        for j in range(d):
            q, avg, var = r[f"c{3 * j}"], r[f"c{3 * j + 1}"], r[f"c{3 * j + 2}"]
            out.center[t, j], out.scale[t, j], out.keep[t, j], out.edges[t, j] = q[1], (q[2] - q[0]) or 1.0, var > 0, q[3:]
            mean[j], square[j] = (avg - q[1]) / out.scale[t, j], var / out.scale[t, j] ** 2
        live = out.keep[t] > 0
        if live.any():
            out.variance[t] = (square + mean**2)[live].mean() - mean[live].mean() ** 2
        out.weight[t] = r["n"] / (2 * max(r["n"] - r["p"], 1)), r["n"] / (2 * max(r["p"], 1))
    return out


def summed(rows: DataFrame, partial: Callable[[Rows], Iterator[tuple[int, np.ndarray]]], finish: Callable[[int, np.ndarray], np.ndarray] = lambda k, v: v) -> dict[int, np.ndarray]:
    """Arrays by key, added up over all rows: within a task first, then by key; finish runs where a key's sum is complete."""

    def pack(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "v"])

    def own(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for k, v in partial(Rows.of(b)):
                    total[k] = total[k] + v if k in total else v
        yield pack(total)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("v"), strict=True):
                v = np.frombuffer(v.as_py())
                total[k] = total[k] + v if k in total else v
        yield pack({k: finish(k, v) for k, v in total.items()})

    out = rows.mapInArrow(own, "k int, v binary").repartition(ADDERS, "k").mapInArrow(add, "k int, v binary")
    return {r.k: np.frombuffer(r.v) for r in out.collect()}


@dataclass(frozen=True)
class Fitted:
    """A learner's models: predict(set, point of the grid, x) for `grid` points."""

    grid: int
    predict: Callable[[int, int, np.ndarray], np.ndarray]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit_logistic(rows: DataFrame, design: Design, s: Scales, costs: list[float], steps: int = 60, close: float = 1e-10) -> Fitted:
    """[MLE01] Balanced logistic regression: the least of |w|^2 / 2 + C * weighted log loss, the intercept in w, for every set and C.

    Newton's method; a step that does not lower a model's loss is halved. A model leaves the passes when its step is below `close`.
    """
    sets, d = design.sets(), s.center.shape[1] + 1
    models = [(t, c) for t in range(len(sets)) for c in range(len(costs))]
    w = np.zeros((len(models), d))
    best, way, size, loss = w.copy(), np.zeros_like(w), np.ones(len(models)), np.full(len(models), np.inf)
    active = set(range(len(models)))
    for _ in range(steps):
        now = w.copy()
        live = sorted(active)

        def partial(r: Rows, now=now, live=live):
            for m in live:
                t, _ = models[m]
                on = r.trains(design, *sets[t])
                if on.any():
                    x, y = np.column_stack([s.scaled(t, r.x[on]), np.ones(on.sum())]), r.y[on]
                    z, a = x @ now[m], s.weight[t][y.astype(int)]
                    p = sigmoid(z)
                    yield m, np.concatenate([[(a * (np.logaddexp(0, z) - y * z)).sum()], x.T @ (a * (p - y)), (x.T @ (x * (a * p * (1 - p))[:, None])).ravel()])

        sums = summed(rows, partial)
        for m in live:
            if m not in sums:
                active.discard(m)
                continue
            cost, v = costs[models[m][1]], sums[m]
            at = w[m] @ w[m] / 2 + cost * v[0]
            if at > loss[m] + 1e-12 * abs(loss[m]):
                size[m] /= 2
            else:
                best[m], loss[m], size[m] = w[m], at, 1.0
                way[m] = np.linalg.solve(np.eye(d) + cost * v[1 + d :].reshape(d, d), w[m] + cost * v[1 : 1 + d])
            if size[m] * np.abs(way[m]).max() < close:
                active.discard(m)
                w[m] = best[m]
            else:
                w[m] = best[m] - size[m] * way[m]
        if not active:
            break
    k = len(costs)
    return Fitted(k, lambda t, c, x: sigmoid(np.column_stack([s.scaled(t, x), np.ones(len(x))]) @ w[t * k + c]))


def fit_kernel(rows: DataFrame, design: Design, s: Scales, costs: list[float], gammas: list[float | str], features: int, seed: int) -> Fitted:
    """[MLE01] An RBF kernel by random Fourier features with a least-squares margin, balanced: one Gram matrix for each set and gamma, then a solve for each C.

    A substitute for the hinge loss: the matrices are sums, so one pass fits all sets. gamma "scale" is 1 / (features that vary x
    variance of scaled entries). The score is a sigmoid of twice the margin, in the margin's order.
    """
    sets, d = design.sets(), s.center.shape[1]
    rng = np.random.default_rng(seed)
    way, phase = rng.normal(size=(d, features)), rng.uniform(0, 2 * np.pi, features)

    def mapped(t: int, g: int, x: np.ndarray) -> np.ndarray:
        gamma = 1 / (max(s.keep[t].sum(), 1) * (s.variance[t] or 1)) if gammas[g] == "scale" else gammas[g]
        return np.column_stack([np.sqrt(2 / features) * np.cos(np.sqrt(2 * gamma) * s.scaled(t, x) @ way + phase), np.ones(len(x))])

    def partial(r: Rows):
        for t, of in enumerate(sets):
            on = r.trains(design, *of)
            if on.any():
                y, a = r.y[on], s.weight[t][r.y[on].astype(int)]
                for g in range(len(gammas)):
                    z = mapped(t, g, r.x[on])
                    yield t * len(gammas) + g, np.concatenate([(z.T @ (z * a[:, None])).ravel(), z.T @ (a * (2 * y - 1))])

    k, w = len(costs), {}
    for key, v in summed(rows, partial).items():
        gram, right = v[: (features + 1) ** 2].reshape(features + 1, -1), v[(features + 1) ** 2 :]
        for c, cost in enumerate(costs):
            w[key // len(gammas), key % len(gammas) * k + c] = np.linalg.solve(gram + np.eye(features + 1) / cost, right)
    return Fitted(k * len(gammas), lambda t, c, x: sigmoid(2 * mapped(t, c // k, x) @ w[t, c]) if (t, c) in w else np.full(len(x), 0.5))


def draws(h: np.ndarray, trees: int, seed: int, first: int = 0) -> np.ndarray:
    """How often each row is in the bootstrap of each tree from `first` on: Poisson numbers from a digest of row and tree, the same in any partitioning."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64)[:, None] + np.arange(first + 1, first + trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    n, p, upto = np.zeros(u.shape), np.exp(-1.0), np.exp(-1.0)
    for k in range(1, 12):
        n += u > upto
        p /= k
        upto += p
    return n


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of a set and grid point: feature (-1 in a leaf), threshold and share of class 1 of each node; children of k are 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    share: np.ndarray

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row in each tree after so many levels; rows stay in leaves."""
        at, tree = np.zeros((len(x), len(self.feature)), np.int64), np.arange(len(self.feature))
        for _ in range(levels):
            f = self.feature[tree, at]
            left = np.take_along_axis(x, np.maximum(f, 0), axis=1) <= self.threshold[tree, at]
            at = np.where(f >= 0, 2 * at + 1 + ~left, at)
        return at

    def score(self, x: np.ndarray, depth: int) -> np.ndarray:
        each = (x[i : i + PIECE] for i in range(0, max(len(x), 1), PIECE))
        return np.concatenate([self.share[np.arange(len(self.share)), self.nodes(p, depth)].mean(axis=1) for p in each])

    def some(self, a: int, z: int) -> Trees:
        return Trees(self.feature[a:z], self.threshold[a:z], self.share[a:z])


def splits(sums: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best (candidate, bin), whether there is one, and the shares of class 1 of a node, left and right, from sums [..., candidate, bin, (draws, weight 0, weight 1)]."""
    left = sums.cumsum(axis=-2)[..., :-1, :]
    right = sums.sum(axis=-2, keepdims=True) - left
    gini = lambda v: 2 * v[..., 1] * v[..., 2] / np.maximum(v[..., 1] + v[..., 2], 1e-300)
    fits = (left[..., 0] >= least) & (right[..., 0] >= least)
    cost = np.where(fits, gini(left) + gini(right), np.inf)
    flat = cost.reshape(*cost.shape[:-2], -1)
    best = flat.argmin(axis=-1)
    node = sums[..., 0, :, :].sum(axis=-2)
    good = np.take_along_axis(flat, best[..., None], -1)[..., 0] < gini(node) - 1e-12
    f, b = np.divmod(best, cost.shape[-1])
    pick = lambda v: np.take_along_axis(np.take_along_axis(v, f[..., None, None, None], -3)[..., 0, :, :], b[..., None, None], -2)[..., 0, :]
    share = lambda v: v[..., 2] / np.maximum(v[..., 1] + v[..., 2], 1e-300)
    return np.where(good, f, -1), b, share(node), share(pick(left)), share(pick(right))


def grow(rows: DataFrame, design: Design, s: Scales, trees: int, depth: int, leaves: list[int], seed: int, sampled: bool = True) -> dict[int, Trees]:
    """[MLE01, MLE18] Trees for every set and least leaf, level by level: one pass a level adds up the class weights of every open node's bins.

    Gini splits at the edges of a set's bins over a random root of the features for each node; balanced class weights. With
    sampled=False a tree sees every row once and every feature.
    """
    sets, d, k = design.sets(), s.center.shape[1], len(leaves)
    tried = max(1, int(d**0.5)) if sampled else d
    total = 2 ** (depth + 1) - 1
    done = {m: Trees(np.full((trees, total), -1), np.zeros((trees, total)), np.zeros((trees, total))) for m in range(len(sets) * k)}
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        pick = np.random.default_rng([seed, level]).random((len(sets), trees, width, d)).argsort(axis=-1)[..., :tried] if sampled else np.broadcast_to(np.arange(d), (len(sets), trees, width, d))

        def partial(r: Rows, level=level, first=first, width=width, pick=pick):
            for t, of in enumerate(sets):
                on = r.trains(design, *of)
                if not on.any():
                    continue
                x, y = r.x[on], r.y[on].astype(int)
                bins = np.column_stack([np.searchsorted(s.edges[t, j], x[:, j]) for j in range(d)])
                found = [[] for _ in range(k)]
                for a, z in ((a, min(a + TREES, trees)) for a in range(0, trees, TREES)):
                    n = draws(r.hash[on], z - a, seed + t, a) if sampled else np.ones((len(x), z - a))
                    for q in range(k):
                        at = done[t * k + q].some(a, z).nodes(x, level)
                        # rows that ended in a leaf above have no part in this level
                        row, of_tree = np.nonzero((n > 0) & (at >= first))
                        node = at[row, of_tree] - first
                        f = pick[t, a + of_tree, node]
                        cell = (((of_tree * width + node)[:, None] * tried + np.arange(tried)) * BINS + bins[row[:, None], f]).ravel()
                        weight = n[row, of_tree]
                        by = lambda v, cell=cell, many=z - a: np.bincount(cell, np.repeat(v, tried), many * width * tried * BINS)
                        c = weight * s.weight[t][y[row]]
                        found[q].append(np.stack([by(weight), by(c * (y[row] == 0)), by(c * (y[row] == 1))], axis=-1).ravel())
                for q in range(k):
                    yield t * k + q, np.concatenate(found[q])

        def finish(m: int, v: np.ndarray, width=width):
            return np.stack(splits(v.reshape(trees, width, tried, BINS, 3), leaves[m % k]), axis=-1).astype(float).ravel()

        for m, v in summed(rows, partial, finish).items():
            c, b, share, left, right = np.moveaxis(v.reshape(trees, width, 5), -1, 0)
            one, t = done[m], m // k
            at = np.arange(first, first + width)
            feature = np.take_along_axis(pick[t], np.maximum(c, 0).astype(int)[..., None], -1)[..., 0]
            open_ = c >= 0
            one.feature[:, at] = np.where(open_, feature, -1)
            one.threshold[:, at] = s.edges[t][feature, b.astype(int)]
            if level == 0:
                one.share[:, at] = share
            one.share[:, 2 * at + 1], one.share[:, 2 * at + 2] = np.where(open_, left, 0), np.where(open_, right, 0)
    return done


def fit_forest(rows: DataFrame, design: Design, s: Scales, trees: int, depths: list[int], leaves: list[int], seed: int) -> Fitted:
    """[MLE01] Balanced random forest over a grid of depth and least leaf: trees are grown to the largest depth, a smaller one is the same tree cut off."""
    done, k = grow(rows, design, s, trees, max(depths), leaves, seed), len(leaves)
    return Fitted(len(depths) * k, lambda t, c, x: done[t * k + c % k].score(x, depths[c // k]))


def nested_cv(rows: DataFrame, design: Design, fitted: Fitted) -> DataFrame:
    """[MLE02] id, fold, y, choice, score: for each row the score of the model chosen for its outer fold and fitted without it.

    A model is chosen by the mean, over inner folds that have one, of the average precision on the fold held out; ties go to the
    first of the grid. Only those means reach the driver.
    """
    kinds = "o int, i int, c int, y double, score double"

    def inner(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r = Rows.of(b)
            for o, i in design.sets():
                on = (r.fold != o) & (r.held[:, o] == i)
                if i < design.inner and on.any():
                    for c in range(fitted.grid):
                        score = fitted.predict(design.at(o, i), c, r.x[on])
                        yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(score), v, np.int32)) for v in (o, i, c)), pa.array(r.y[on]), pa.array(score)], ["o", "i", "c", "y", "score"])

    chosen = dict.fromkeys(range(design.outer), 0)
    if fitted.grid > 1:
        ap = ranking_metrics(rows.mapInArrow(inner, kinds), ["o", "i", "c"], "score", "y").groupBy("o", "c").agg(F.avg("average_precision").alias("ap")).filter("ap IS NOT NULL").collect()
        for o in chosen:
            chosen[o] = min(((-round(r.ap, 12), r.c) for r in ap if r.o == o), default=(0, 0))[1]

    def outer(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r, score = Rows.of(b), np.zeros(b.num_rows)
            for o, c in chosen.items():
                if (on := r.fold == o).any():
                    score[on] = fitted.predict(design.at(o, design.inner), c, r.x[on])
            picks = pa.array(np.array([chosen[int(f)] for f in r.fold], np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("fold"), b.column("y"), picks, pa.array(score)], ["id", "fold", "y", "choice", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(outer, f"id {kind}, fold int, y double, choice int, score double")


def both_ways(df: DataFrame, item: str, features: list[str], label: str) -> DataFrame:
    """[MLE15] Each pair as given (way 1) and reversed (way -1): features negated, label turned; item is the pair's."""
    turned = df.withColumns({f: -F.col(f) for f in features} | {label: 1 - F.col(label)})
    rows = df.withColumn("way", F.lit(1)).unionByName(turned.withColumn("way", F.lit(-1)))
    return rows.withColumn("reading", F.struct(item, "way").cast("string"))


def antisymmetric(scored: DataFrame, item: str) -> DataFrame:
    """[MLE16, MLE19] item, y, s, agrees: s = f(D) - f(-D) of each pair; the sign agrees with the label, a zero never does.

    scored: item, way, y, score of both readings. One aggregate by pair.
    """
    of = lambda c, way: F.max(F.when(F.col("way") == way, F.col(c)))
    s = scored.groupBy(item).agg(of("y", 1).alias("y"), (of("score", 1) - of("score", -1)).alias("s"))
    return s.withColumn("agrees", F.signum("s") == 2 * F.col("y") - 1)


def directions(df: DataFrame, features: list[str], label: str) -> dict[str, int]:
    """[MLE18] For each feature 1 if a rise goes with label 1 at least as often as a fall does, else -1: one aggregate."""
    y = F.col(label) == 1
    sums = [e for f in features for e in (F.count_if((F.col(f) > 0) == y).alias(f"{f}_up"), F.count_if((F.col(f) < 0) == y).alias(f"{f}_down"))]
    r = df.agg(*sums).first()
    return {f: 1 if r[f"{f}_up"] >= r[f"{f}_down"] else -1 for f in features}


def hand_rules(features: list[str], turn: dict[str, int]) -> dict[str, Column]:
    """[MLE17, MLE18] name to a column that is true where the rule says 1: the sign of each feature, ties broken by the next (lex2, lex3), votes of the first two and three.

    features in order of importance. Nothing moves: the rule says 0.
    """
    v = {f: F.col(f) * turn[f] for f in features}
    sign = lambda f: F.nullif(F.signum(v[f]), F.lit(0.0))
    out = {f"sign_{f}": v[f] > 0 for f in features}
    for k in (2, 3):
        if len(features) >= k:
            out[f"lex{k}"] = F.coalesce(*(sign(f) for f in features[:k]), F.lit(0.0)) > 0
            out[f"vote{k}"] = sum((F.signum(v[f]) for f in features[1:k]), F.signum(v[features[0]])) > 0
    return out


def shuffled(rows: DataFrame, keys: list[str], item: str, column: str, repeats: int, seed: int) -> DataFrame:
    """rows once for each repeat from 1, with given_: `column` of another row of the same keys, dealt by two orders of digests.

    Every row gives to one row and takes from one. Orders are ranks inside ranges of the digest, whose sizes are counted first, so a
    large key is dealt to many tasks.
    """
    many = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    by = [*keys, "repeat"]

    def ranked(salt: str) -> DataFrame:
        own = many.withColumn("h_", F.pmod(F.xxhash64("repeat", F.lit(f"{seed}{salt}"), item), F.lit(1 << 40))).withColumn("c_", F.shiftright("h_", 34))
        before = Window.partitionBy(*by).orderBy("c_").rowsBetween(Window.unboundedPreceding, -1)
        below = own.groupBy(*by, "c_").count().select(*by, "c_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below_"))
        inside = F.row_number().over(Window.partitionBy(*by, "c_").orderBy("h_", item))
        return own.withColumn("k_", inside).join(below, [*by, "c_"]).withColumn("r_", F.col("below_") + F.col("k_"))

    return ranked("to").drop("h_", "c_", "k_", "below_").join(ranked("from").select(*by, "r_", F.col(column).alias("given_")), [*by, "r_"]).drop("r_")


def permutation_drop(rows: DataFrame, design: Design, fitted: Fitted, choices: dict[int, int], repeats: int, seed: int) -> DataFrame:
    """[MLE14] feature, drop: how much accuracy at 0.5 the model of each outer fold loses on its own test rows when one feature is dealt anew among
    all of them, meant over repeats and weighted by the size of folds.

    A repeat deals whole rows; each feature takes its value from the row given, one at a time.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r = Rows.of(b)
            given = b.column("given_").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            lost = np.zeros(r.x.shape, np.int64)
            for o, c in choices.items():
                on = r.fold == o
                if on.any():
                    right = lambda x, o=o, c=c, on=on: (fitted.predict(design.at(o, design.inner), c, x) >= 0.5) == (r.y[on] > 0)
                    base = right(r.x[on]).astype(int)
                    for j in range(r.x.shape[1]):
                        moved = r.x[on].copy()
                        moved[:, j] = given[on, j]
                        lost[on, j] = base - right(moved)
            d = lost.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(lost.sum(axis=0)), pa.array(np.full(d, b.num_rows, np.int64))], ["feature", "lost", "n"])

    parts = shuffled(rows, ["fold"], "id", "x", repeats, seed).mapInArrow(run, "feature int, lost long, n long")
    return parts.groupBy("feature").agg((F.sum("lost") / F.sum("n")).alias("drop"))

"""Embedding whitening (13): singular values, vectors and means of partitions, merged level by level without losing a dimension."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread, table

#: Fixed values of the contract: units of a whole number in 1.0, components returned.
UNITS, COMPONENTS = 256, 4
#: Rows decomposed at a time, states merged in one group.
ROWS, FAN_IN = 4096, 16
STATE = "node long, child long, n long, total array<string>, factor binary"
#: Whole numbers below this are exact as doubles, and their sums over ROWS rows as longs.
LARGEST = 1 << 50


@dataclass(frozen=True)
class State:
    """Of n rows: the exact sum of each dimension, and factor = singular values times right vectors of the centred rows, all dimensions."""

    n: int
    total: list[int]
    factor: np.ndarray

    def mean(self) -> np.ndarray:
        return np.array([t / self.n for t in self.total])


def factored(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors; as many rows as dimensions, zeros where there are fewer."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    out = np.zeros((rows.shape[1], rows.shape[1]))
    out[: len(s)] = s[:, None] * vt
    return out


def state_of(rows: np.ndarray) -> State:
    """The state of a block of whole numbers."""
    total = rows.sum(axis=0)
    return State(len(rows), total.tolist(), factored(rows - total / len(rows)))


def merged(a: State, b: State) -> State:
    """Both as one: factors stacked with sqrt(n m / (n + m)) times the difference of the means, decomposed again."""
    n = a.n + b.n
    gap = np.sqrt(a.n / n * b.n) * (a.mean() - b.mean())
    return State(n, [s + t for s, t in zip(a.total, b.total, strict=True)], factored(np.vstack([a.factor, b.factor, gap])))


def packed(node: int, s: State) -> pa.RecordBatch:
    values = (node, 0, s.n, list(map(str, s.total)), s.factor.tobytes())
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["node", "child", "n", "total", "factor"])


def unpacked(n: int, total: list[str], factor: bytes) -> State:
    return State(n, list(map(int, total)), np.frombuffer(factor).reshape(len(total), -1))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def whole_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x, the vector in whole units: floor(UNITS * c) of each entry.

    Vectors null, empty or with an entry null or not finite take no part, nor do those of another length than the longest.
    An entry of LARGEST units or more ends the job. vec_id may be null or repeat. Other columns are not read.
    """
    c = F.col("c")
    rows = spread(embeddings.sparkSession, embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("c")))
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.filter(c.isNotNull() & (F.size(c) > 0) & ~bad)
    longest = rows.agg(F.max(F.size(c))).first()[0]
    whole = lambda e: F.when(F.abs(e) * UNITS < LARGEST, F.floor(e * UNITS)).otherwise(F.raise_error(F.lit("an entry is too large")))
    return rows.filter(F.size(c) == F.lit(longest)).select("vec_id", F.transform(c, whole).alias("x"))


def fit(distinct: DataFrame) -> State | None:
    """The state of all rows of column x; None without rows.

    A partition reduces its blocks to one state of d by d numbers; levels of FAN_IN states merge until one is left, which
    alone reaches the driver. What a task holds is two states, whatever the number of rows.
    """

    def start(batches):
        own = None
        for b in batches:
            rows = matrix(b.column("x"))
            for k in range(0, len(rows), ROWS):
                block = state_of(rows[k : k + ROWS])
                own = merged(own, block) if own else block
        if own:
            yield packed(0, own)

    def level(batches):
        node, own = None, None
        for b in batches:
            for at, _, *state in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one = unpacked(*state)
                if own and at != node:
                    yield packed(node, own)
                    own = None
                node, own = at, merged(own, one) if own else one
        if own:
            yield packed(node, own)

    states = cut(distinct.select("x").mapInArrow(start, STATE).withColumn("node", F.spark_partition_id().cast("long")))
    top = states.agg(F.max("node")).first()[0]
    if top is None:
        return None
    while True:
        grouped = states.withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / FAN_IN))
        states = cut(grouped.repartition("node").sortWithinPartitions("node", "child").mapInArrow(level, STATE))
        top //= FAN_IN
        if not top:
            return unpacked(*states.first()[2:])


@dataclass(frozen=True)
class Whitening:
    """n, S and the unit eigenvectors of the covariance (rows, by falling eigenvalue) with their eigenvalues; all dimensions."""

    n: int
    total: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray

    @staticmethod
    def of(s: State) -> Whitening:
        _, values, components = np.linalg.svd(s.factor)
        return Whitening(s.n, s.total, components, values**2 / s.n)

    def varying(self) -> np.ndarray:
        """Which components have a variance beyond rounding."""
        return self.eigenvalues > self.eigenvalues.sum() * len(self.total) * np.finfo(float).eps

    def explained(self, k: int) -> float | None:
        trace = self.eigenvalues.sum()
        return float(self.eigenvalues[k] / trace) if trace else None

    def apply(self, x: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray]:
        """deviation of each row, exact, and its first `most` whitened coordinates; NaN for a component without variance."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.total))
        fits = top * top * x.shape[1] < 1 << 63
        # numbers of any size where longs would overflow
        scaled = self.n * (x if fits else x.astype(object)) - np.array(self.total, np.int64 if fits else object)
        squares = (scaled * scaled).sum(axis=1).tolist()
        deviation = pa.array([Decimal(v) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
        scale = np.where(self.varying(), np.sqrt(self.eigenvalues), np.nan)[:most]
        return deviation, (scaled / self.n).astype(float) @ self.components[:most].T / scale


def whitened_rows(x: DataFrame, model: Whitening, most: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation decimal(38, 0) (null beyond it) and whitened, an array of the first `most` coordinates, null for a component without variance."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                deviation, w = model.apply(matrix(b.column("x")), most)
                values = pa.array(w.ravel(), from_pandas=True)
                starts = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, pa.ListArray.from_arrays(starts, values)], ["vec_id", "deviation", "whitened"])

    return x.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(fit_rows: DataFrame, model: Whitening, most: int = COMPONENTS) -> float | None:
    """The largest entry of the whitened covariance over the fit list minus the identity, measured on the rows; None where no component varies."""
    live = [k for k in range(min(most, len(model.total))) if model.varying()[k]]
    w = whitened_rows(fit_rows.select(F.lit(None).cast("long").alias("vec_id"), "x"), model, most).select(*(F.col("whitened")[k].alias(f"w{k}") for k in live))
    entries = [F.abs(F.covar_pop(f"w{a}", f"w{b}") - F.lit(float(a == b))) for a, b in combinations_with_replacement(live, 2)]
    return max(w.agg(*(e.alias(f"e{i}") for i, e in enumerate(entries))).first()) if live else None


def whiten(embeddings: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation decimal(38, 0), whitened, explained, identity_error for each usable row and its first `most` components.

    whole_vectors says which rows take part. The fit list is each distinct whole vector once, n of them. A component without
    variance beyond rounding (fewer distinct vectors than dimensions, for one) has whitened null; explained and identity_error
    are null where nothing varies. No usable rows, no result. Components keep one sign for all rows.

    Equal vectors fold before the exchange, so a common one is no load; the model, d by d numbers, travels with the function.
    """
    x = whole_vectors(embeddings, column)
    distinct = cut(x.groupBy("x").count().select("x"))
    state = fit(distinct)
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if state is None:
        return embeddings.sparkSession.createDataFrame([], out)
    model = Whitening.of(state)
    explained = F.array(*(F.lit(model.explained(k)).cast("double") for k in range(min(most, len(model.total)))))
    rows = whitened_rows(x, model, most).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("k")].alias("explained"), F.lit(identity_error(distinct, model, most)).cast("double").alias("identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))

"""Best-fit packing (2): Martello-Toth dominance fixes sets of lengths, best fit packs the rest, both on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import word_bpe
from .common import cut, doc_rows, parts, slices, spread, table

#: Pieces of one length ranked in one task at most, about; characters of text encoded at a time.
RANKED, SLICE = 50_000, 4_000_000
#: A decision of the reduction looks at no more items of a length than this.
MARGIN = 4
END_ID = b"\0\0\0\0"


class Lengths:
    """Counts of lengths and the lengths in ascending order."""

    def __init__(self, left: dict[int, int]):
        self.left, self.order = left, sorted(left)

    def free(self, x: int, j: int) -> int:
        """Items of length x beside one of length j."""
        return self.left[x] - (x == j)

    def take(self, items: tuple[int, ...]) -> int:
        """Take a set as often as no count that a decision looks at (up to MARGIN) changes, once at least."""
        need = Counter(items)
        times = max(1, min((self.left[x] - MARGIN) // m for x, m in need.items()))
        for x, m in need.items():
            self.left[x] -= m * times
            if not self.left[x]:
                del self.left[x]
                del self.order[bisect_left(self.order, x)]
        return times

    def smallest(self, j: int, over: int, most: int) -> list[int]:
        """The `most` smallest items longer than `over`, beside one of length j."""
        out: list[int] = []
        for x in self.order[bisect_right(self.order, over) :]:
            out += [x] * min(most - len(out), self.free(x, j))
            if len(out) == most:
                break
        return out

    def largest(self, j: int, gap: int) -> int:
        """The longest item of at most `gap`, beside one of length j; 0 if there is none."""
        i = bisect_right(self.order, gap) - 1
        while i >= 0 and not self.free(self.order[i], j):
            i -= 1
        return self.order[i] if i >= 0 else 0

    def best_pair(self, j: int, gap: int) -> tuple[int, int]:
        """The two items, the longer first, that fill `gap` best."""
        best, lo, hi = (0, 0), 0, bisect_right(self.order, gap) - 1
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if a + b > gap or not self.free(b, j):
                hi -= 1
            elif not self.free(a, j) or (a == b and self.free(a, j) < 2):
                lo += 1
            else:
                best = max(best, (b, a), key=sum)
                lo += 1
        return best


def dominating(lengths: Lengths, j: int, room: int) -> tuple[int, ...] | None:
    """The set with j that dominates every other set with j, if Martello and Toth's rules find one.

    k of the smallest items fit beside j. k = 0: j alone. The longest item that fits dominates where it fills the gap, where
    k = 1, or where k = 2 and no pair sums to more. For k = 2, the best pair dominates where its longer item is the longest
    that fits and no pair that fits has both items longer than its shorter one.
    """
    gap = room - j
    if gap in lengths.left and lengths.free(gap, j):
        return (j, gap)
    best = lengths.largest(j, gap)
    if not best:
        return (j,)
    small = np.cumsum(lengths.smallest(j, 0, 3))
    k = int((small <= gap).sum())
    if k == 1:
        return (j, best)
    if k == 2:
        a, b = lengths.best_pair(j, gap)
        if best >= a + b:
            return (j, best)
        over = lengths.smallest(j, b, 2)
        if a == best and (len(over) < 2 or sum(over) > gap):
            return (j, a, b)
    return None


def reduce_by_dominance(left: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that dominate all others with one of their items, take them from `left` (length: count), and go on until no item has one."""
    lengths, fixed, more = Lengths(left), [], True
    while more:
        more = False
        for j in lengths.order[::-1]:
            while j in left and (items := dominating(lengths, j, room)):
                fixed.append((items, lengths.take(items)))
                more = True
    return fixed


def best_fit(left: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: the fullest sequence that still takes an item takes as many of its length as fit."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for x in sorted(left, reverse=True):
        n = left[x]
        for gap in sorted(g for g in bins if g >= x):
            while n and bins[gap]:
                items, times = bins[gap].pop()
                t = min(gap // x, n)
                use = min(times, n // t)
                bins[gap - t * x].append((items + (x,) * t, use))
                n -= use * t
                if times > use:
                    bins[gap].append((items, times - use))
            if not n:
                break
        each = room // x
        if n >= each:
            bins[room - each * x].append(((x,) * each, n // each))
        if n % each:
            bins[room - n % each * x].append(((x,) * (n % each), 1))
    return [p for held in bins.values() for p in held]


def plan(lengths: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Sets of lengths and how often each is used; every item once, no set beyond `room`."""
    left = {x: n for x, n in lengths.items() if n}
    return reduce_by_dominance(left, room) + best_fit(left, room)


def places(sets: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length its places by rank: rows (first rank, items in a sequence, first sequence, offset)."""
    rank, out, seq = Counter(), defaultdict(list), 0
    for items, times in sets:
        at = 0
        for x, t in Counter(items).items():
            out[x].append((rank[x], t, seq, at))
            rank[x] += t * times
            at += t * x
        seq += times
    return {x: np.array(v, np.int64) for x, v in out.items()}


def pieces_of(docs: DataFrame, tokenizer: str, room: int, with_ids: bool) -> DataFrame:
    """row (unique once written), doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""

    def run(batches):
        ids, part, n = word_bpe.ids(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            texts = (t for _, some in slices(b.column("text"), SLICE) for t in ids.encode(some))
            for doc, text in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                got = text + END_ID
                for k in range(0, len(got), 4 * room):
                    piece = got[k : k + 4 * room]
                    out.append(((part << 40) + n, doc, k // 4 // room, k // 4, len(piece) // 4, zlib.crc32(piece), *[piece] * with_ids))
                    n += 1
            cols = list(zip(*out, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return spread(docs.sparkSession, doc_rows(docs)).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 2048, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with_ids, ids of each piece.

    A document is its ids and id 0; a null or empty text is id 0 alone. Only documents longer than `room` are cut. Rows
    that repeat an id are packed each. An empty table gives an empty result.

    Pieces are written once to the shared folder. The histogram of lengths, at most `room` rows, goes to the driver,
    which plans sets of lengths; pieces find their place by their rank among those of their length. Ranks come from
    counts by (length, group) and a row number inside the group, so no length meets in one task.
    """
    pieces = cut(pieces_of(docs, tokenizer, room, with_ids))
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    where = places(plan(lengths, room))
    groups = parts(sum(lengths.values()), RANKED, 256)
    keys = pieces.drop("ids").withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    counts = keys.groupBy("length", "g").count().select("length", "g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below"))
    ranked = keys.withColumn("r", F.row_number().over(Window.partitionBy("length", "g").orderBy("row"))).join(counts, ["length", "g"])

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("r").to_numpy()
            seq, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length):
                own = length == x
                first, t, s, at = where[int(x)][np.searchsorted(where[int(x)][:, 0], rank[own], side="right") - 1].T
                seq[own] = s + (rank[own] - first) // t
                offset[own] = at + (rank[own] - first) % t * x
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    cols = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = ranked.select(*cols, (F.col("r") - 1 + F.col("below")).cast("long").alias("r")).mapInArrow(run, schema)
    if with_ids:
        out = out.join(pieces.select("row", "ids"), "row")
    return out.drop("row")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)

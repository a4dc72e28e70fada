"""Documents in shards by a hash, and keys that shards exchange by bucket: packed, so a shard sends one row to a bucket."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, text_bytes

#: Text of a shard and of what meets in a bucket, in bytes, about.
SHARD, BUCKET = 4 << 20, 16 << 20
#: A null id counts as the largest.
NO_ID = np.iinfo(np.int64).max
KEY = "__shard"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
SPANS_SQL = "array<struct<start: bigint, length: bigint>>"


def sharded(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(KEY, doc_id, text), all columns with KEY, bytes of text. Nulls in text stay in the second."""
    total = text_bytes(docs)
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    shard = F.pmod(F.xxhash64(doc, text), F.lit(parts(total, SHARD))).cast("int")
    return docs.select(shard.alias(KEY), doc.alias("doc_id"), text.alias("text")), docs.withColumn(KEY, shard), total


def in_order(group: pa.Table) -> pa.Table:
    """Rows by id and text: two reads of a shard may bring its rows in different orders, and places must mean the same bytes in both."""
    return group.take(pc.sort_indices(group, [("doc_id", "ascending"), ("text", "ascending")]))


class Shard:
    """Texts of a shard as one byte array with `gap` zero bytes before each and after the last. Places that leave a pass need a group in_order."""

    def __init__(self, group: pa.Table, gap: int):
        ids = group["doc_id"].cast(pa.int64()).combine_chunks()
        self.doc_id = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        texts = [b"" if t is None else t.encode() for t in group["text"].to_pylist()]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(np.concatenate(([gap], self.length[:-1] + gap))).astype(np.int64)[: len(texts)]
        blank = bytes(gap)
        self.raw = blank + blank.join(texts) + blank
        self.data = np.frombuffer(self.raw, np.uint8)

    def owner(self) -> np.ndarray:
        """Row of each byte, -1 in gaps."""
        out = np.full(len(self.data), -1, np.int32)
        for k, (s, n) in enumerate(zip(self.start, self.length, strict=True)):
            out[s : s + n] = k
        return out

    def cover(self, gone: np.ndarray, group: pa.Table, with_text: bool) -> dict[str, pa.Array]:
        """What stays where `gone` (of each byte) is set: text, n_bytes, n_removed, removed_spans, kept_sha256."""
        text, removed, spans, sha = [], [], [], []
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        lo, hi = edge[::2], edge[1::2]
        at = np.searchsorted(lo, self.start)
        for s, n, i in zip(self.start.tolist(), self.length.tolist(), at.tolist(), strict=True):
            own, parts_, last = [], [], s
            while i < len(lo) and lo[i] < s + n:
                a, b = int(lo[i]), int(hi[i])
                own.append({"start": a - s, "length": b - a})
                parts_.append(self.raw[last:a])
                last = b
                i += 1
            kept = b"".join([*parts_, self.raw[last : s + n]])
            spans.append(own)
            removed.append(n - len(kept))
            sha.append(hashlib.sha256(kept).hexdigest())
            text.append(kept)
        out = {"n_bytes": pa.array(self.length), "n_removed": pa.array(removed, pa.int64()), "removed_spans": pa.array(spans, SPANS), "kept_sha256": pa.array(sha, pa.string())}
        return out | ({"kept": pa.array(text, pa.binary())} if with_text else {})


def ends_of(bucket: np.ndarray) -> dict[int, tuple[int, int]]:
    """Start and end of each bucket's run in an array of bucket numbers that do not fall."""
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    return {int(bucket[a]): (a, z) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)}


def by_bucket(shard: int, bucket: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """One row for each bucket that gets something: shard, bucket, and each column's values as bytes. Rows of a bucket keep their order."""
    order = np.argsort(bucket, kind="stable")
    ends = ends_of(bucket[order])
    sets = {n: v[order] for n, v in columns.items()}
    out = {KEY: pa.array(np.full(len(ends), shard), pa.int32()), "bucket": pa.array(list(ends), pa.int32())}
    return pa.table(out | {n: pa.array([v[a:z].tobytes() for a, z in ends.values()], pa.binary()) for n, v in sets.items()})


def unpack(group: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows of a packed column, and the row of each."""
    blobs = group[name].to_pylist()
    n = [len(b) // np.dtype(kind).itemsize for b in blobs]
    return np.frombuffer(b"".join(blobs), kind), np.repeat(np.arange(len(blobs)), n)

"""Substring dedup (5): chunks cut where a gear hash says so, deduplicated by digest over all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, parts, table
from .shards import BUCKET, KEY, SPANS_SQL, Shard, by_bucket, sharded, unpack

#: A cut depends on this many bytes; one of 2**CUT_BITS places is a cut; repeated chunks in a row go if they span MIN_RUN bytes.
WINDOW, CUT_BITS, MIN_RUN = 16, 5, 128
GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends: the gear hash h = (h << 2) + GEAR[byte] mod 2**32, which forgets a byte after WINDOW steps."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(2 * step))
        step *= 2
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


class Chunks:
    """Chunks of a shard: lo, hi, row, and the distinct digests with the smallest id that holds each."""

    def __init__(self, shard: Shard, buckets: int):
        edges = np.unique(np.concatenate((cuts(shard.data), shard.start, shard.start + shard.length)))
        owner = np.searchsorted(shard.start, edges[:-1], side="right") - 1
        inside = (owner >= 0) & (edges[:-1] < (shard.start + shard.length)[owner]) if len(edges) > 1 and len(shard.start) else np.zeros(max(0, len(edges) - 1), bool)
        self.lo, self.hi, self.row = edges[:-1][inside], edges[1:][inside], owner[inside]
        view, digest = memoryview(shard.raw), xxhash.xxh3_128_digest
        found = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(self.lo.tolist(), self.hi.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
        doc = shard.doc_id[self.row]
        order = np.lexsort((doc, found[:, 1], found[:, 0]))
        f = found[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]).any(1)
        self.of = np.empty(len(f), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.digest, self.first = f[new], doc[order][new]
        # digests are sorted by their first half, so a bucket holds a run of them
        self.bucket = (self.digest[:, 0] >> np.uint64(32)).astype(np.int64) * buckets >> 32


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """All columns of docs, text without the removed spans (with_text), and n_bytes, n_removed, removed_spans, kept_sha256.

    A chunk repeats where a document with a smaller id holds the same bytes; runs of repeated chunks of MIN_RUN bytes at
    least are removed, so chance repeats of a chunk stay. Cuts depend on WINDOW bytes, so an insertion moves no cut
    behind it. A null text is empty and stays null; a null id counts as the largest; rows that repeat an id do not remove
    each other's text; a text that is all repeats becomes empty. Spans count bytes. Columns with names of the added ones
    are replaced.

    Shards by a hash of the row; distinct digests with their smallest id go to buckets, so a passage that a third of all
    documents hold sends one entry for each shard; buckets answer with the smallest id of digests of several shards.
    """
    plain, whole, total = sharded(docs)
    buckets = parts(total, BUCKET)
    added = ["n_bytes", "n_removed", "removed_spans", "kept_sha256"]
    whole = whole.drop(*added) if with_text else whole.select(KEY, "doc_id", "text")

    def offer(group: pa.Table) -> pa.Table:
        fresh()
        c = Chunks(Shard(group, WINDOW), buckets)
        return by_bucket(group[KEY][0].as_py(), c.bucket, digest=c.digest, first=c.first)

    def settle(group: pa.Table) -> pa.Table:
        digest, row = unpack(group, "digest", np.dtype((np.uint64, 2)))
        first, _ = unpack(group, "first", np.int64)
        order = np.lexsort((first, digest[:, 1], digest[:, 0]))
        d = digest[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]).any(1)
        group_of = np.cumsum(new) - 1
        least = np.empty(len(d), np.int64)
        least[order] = first[order][new][group_of]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        tell = np.flatnonzero(least < first)
        shards, bucket = group[KEY].to_numpy(), group["bucket"].to_numpy()
        ends = np.searchsorted(row[tell], np.arange(len(shards) + 1))
        rows = [(int(shards[k]), int(bucket[k]), place[t].astype(np.int64).tobytes(), least[t].tobytes()) for k in range(len(shards)) if len(t := tell[ends[k] : ends[k + 1]])]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table({KEY: pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()), "place": pa.array(cols[2], pa.binary()), "least": pa.array(cols[3], pa.binary())})

    columns = [f for f in whole.schema.fields if f.name != KEY]

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        s = Shard(group, WINDOW)
        c = Chunks(s, buckets)
        least, base = c.first.copy(), np.searchsorted(c.bucket, np.arange(buckets))
        for b, p, m in zip(answers["bucket"].to_pylist(), answers["place"].to_pylist(), answers["least"].to_pylist(), strict=True):
            least[base[b] + np.frombuffer(p, np.int64)] = np.frombuffer(m, np.int64)
        dup = least[c.of] < s.doc_id[c.row]
        start = np.flatnonzero(dup & ~(np.concatenate(([False], dup[:-1])) & np.concatenate(([False], c.row[1:] == c.row[:-1]))))
        end = np.flatnonzero(dup & ~(np.concatenate((dup[1:], [False])) & np.concatenate((c.row[1:] == c.row[:-1], [False]))))
        gone = np.zeros(len(s.data) + 1, np.int32)
        long = c.hi[end] - c.lo[start] >= MIN_RUN
        np.add.at(gone, c.lo[start[long]], 1)
        np.add.at(gone, c.hi[end[long]], -1)
        kept = s.cover(np.cumsum(gone)[:-1] > 0, group, with_text)
        out = {f.name: group[f.name] for f in columns}
        if with_text:
            # removal may cut a letter of several bytes; what is left of it goes as well
            texts = [None if t is None else k.decode("utf-8", "ignore") for t, k in zip(group["text"].to_pylist(), kept.pop("kept").to_pylist(), strict=True)]
            out["text"] = pa.array(texts, pa.string())
        else:
            del out["text"]
        return pa.table(out | kept)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns if with_text or f.name != "text")
    answers = plain.groupBy(KEY).applyInArrow(offer, f"{KEY} int, bucket int, digest binary, first binary").groupBy("bucket").applyInArrow(settle, f"{KEY} int, bucket int, place binary, least binary")
    return whole.groupBy(KEY).cogroup(answers.groupBy(KEY)).applyInArrow(finish, f"{kinds}, n_bytes long, n_removed long, removed_spans {SPANS_SQL}, kept_sha256 string")


def op5_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = substring_dedup(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), "kept_sha256")

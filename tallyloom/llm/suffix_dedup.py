"""Suffix-array dedup (10): bytes of 50-byte strings that start in an earlier document go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, table
from .shards import KEY, SPANS_SQL, Shard, ends_of, in_order, sharded, unpack
from .suffixes import equal_windows, words

#: Length of a repeated string and of the grams whose least hash is a window's key; text of a bucket, in bytes, about; runs of
#: a key beyond which its windows are dealt out by their own digests; bytes from which a removed run counts as a long one.
WIDTH, GRAM, BUCKET, HOT, LONG = 50, 16, 8 << 20, 8192, 256
#: Places whose keys or digests are worked out at a time; text of a bucket that is merged at a time, in bytes, about.
BLOCK, SLICE = 1 << 15, 1 << 20


def window_keys(data: np.ndarray) -> np.ndarray:
    """A key for the WIDTH bytes from each place: the least hash of the grams inside, mixed. Equal windows have equal keys, and neighbours mostly share one.

    A block is worked on while it is in the processor's cache. Places less than WIDTH bytes before the end have some key.
    """
    out = np.empty(len(data), np.uint64)
    for at in range(0, len(data), BLOCK):
        own = keys_of(data[at : at + BLOCK + WIDTH])
        out[at : at + BLOCK] = own[: min(BLOCK, len(data) - at)]
    return out


def keys_of(data: np.ndarray) -> np.ndarray:
    w = words(data)
    h = w * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    far = np.zeros_like(h)
    far[: max(0, len(w) - 8)] = w[8:]
    h += far
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    need, have = WIDTH - GRAM + 1, 1
    while have < need:
        step = min(have, need - have)
        h[:-step] = np.minimum(h[:-step], h[step:])
        have += step
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Windows:
    """Runs of neighbouring windows of one document with one key: start, count, row, key; and the distinct keys by bucket."""

    def __init__(self, shard: Shard, buckets: int):
        self.key_at = window_keys(shard.data)
        big = shard.length >= WIDTH
        self.start, self.count = runs(marked(len(shard.data), shard.start[big], (shard.start + shard.length - WIDTH + 1)[big]), self.key_at)
        self.row = np.searchsorted(shard.start, self.start, side="right") - 1
        key = self.key_at[self.start]
        self.distinct, self.of = np.unique(key, return_inverse=True)
        doc = shard.doc_id[self.row]
        least, most = np.full(len(self.distinct), np.iinfo(np.int64).max), np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, self.of, doc)
        np.maximum.at(most, self.of, doc)
        #: runs of each key, 255 at most; 0 where one document has them all
        self.held = np.where(least < most, np.minimum(np.bincount(self.of, minlength=len(self.distinct)), 255), 0).astype(np.uint8)
        self.ends = ends_of(bucket_of(self.distinct, buckets))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def marked(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of n places, those from a start to before its stop. No more than WIDTH of these overlap at a place."""
    edge = np.zeros(n + 1, np.int16)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge[:-1], dtype=np.int16) > 0


def runs(ok: np.ndarray, key_at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of neighbouring places that are ok, with key_at of those with one key. Documents are apart, so a run lies in one."""
    part = ~(ok[1:] & ok[:-1])
    if key_at is not None:
        part |= key_at[1:] != key_at[:-1]
    start = np.flatnonzero(ok & np.concatenate(([True], part)))
    return start, np.flatnonzero(ok & np.concatenate((part, [True]))) + 1 - start


def earlier_runs(raw: bytes, count: np.ndarray, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that a smaller document has, as runs of windows: number of the run that they lie in, place there, count.

    raw holds the text of the runs one after the other. Equal windows have equal keys, so keys meet in slices of about SLICE
    bytes of text, each key whole in one: what sorting takes does not grow with the bucket.
    """
    size = count + WIDTH - 1
    begin = np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    before = (np.cumsum(size[order]) - size[order])[head] // SLICE
    found = [(np.empty(0, np.int64),) * 3]
    for a, z in ends_of(np.repeat(before, np.diff(np.append(head, len(k))))).values():
        own = order[a:z]
        found += [(own[r], step, n) for r, step, n in earlier_of_slice(raw, begin[own], count[own], doc[own], k[a:z])]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def earlier_of_slice(raw: bytes, begin: np.ndarray, count: np.ndarray, doc: np.ndarray, key: np.ndarray):
    """earlier_runs of runs in order of key, in portions."""
    size = count + WIDTH - 1
    place = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    known: dict[bytes, int] = {}
    text_of = np.fromiter((known.setdefault(raw[b : b + n], len(known)) for b, n in zip(begin.tolist(), size.tolist(), strict=True)), np.int64, len(size))
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, text_of, doc)
    sample = np.zeros(len(known), np.int64)
    sample[text_of] = np.arange(len(text_of))
    alone = np.bincount(place[sample])[place[sample]] == 1
    simple = alone[text_of]
    whole = np.flatnonzero(simple & (least[text_of] < doc))
    yield whole, np.zeros(len(whole), np.int64), count[whole]
    # keys with several texts: a suffix array over the distinct texts finds the least document of each window
    many = np.flatnonzero(~alone)
    if not len(many):
        return
    base = np.zeros(len(known), np.int64)
    base[many] = np.cumsum(size[sample[many]]) - size[sample[many]]
    names = list(known)
    data = np.frombuffer(b"".join([names[k] for k in many.tolist()]), np.uint8)
    valid = marked(len(data), base[many], base[many] + count[sample[many]])
    groups = equal_windows(data, valid, WIDTH)
    low = np.full(groups.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, groups, np.repeat(least[many], count[sample[many]]))
    window_least = np.zeros(len(data), np.int64)
    window_least[valid] = low[groups]
    rest = np.flatnonzero(~simple)
    for a, z in ends_of((np.cumsum(count[rest]) - count[rest]) // SLICE).values():
        r = rest[a:z]
        n = count[r]
        run = np.repeat(np.arange(len(r)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        mark = np.flatnonzero(window_least[base[text_of[r]][run] + step] < doc[r][run])
        new = np.ones(len(mark), bool)
        new[1:] = (mark[1:] != mark[:-1] + 1) | (run[mark[1:]] != run[mark[:-1]])
        head = np.flatnonzero(new)
        yield r[run[mark[head]]], step[mark[head]], np.diff(np.append(head, len(mark)))


def by_shard(group: pa.Table, row: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.Table:
    """Runs to be removed, packed for the shard that sent their row of the group."""
    order = np.argsort(row, kind="stable")
    start, count, ends = start[order].astype(np.int64), count[order].astype(np.int64), ends_of(row[order])
    cols = [group[KEY].take(pa.array(list(ends), pa.int64())), *[pa.array([v[a:z].tobytes() for a, z in ends.values()], pa.binary()) for v in (start, count)]]
    return pa.table(cols, [KEY, "start", "count"])


def by_digest(s: Shard, mine: int, at: np.ndarray, buckets: int) -> list[tuple]:
    """Windows of hot keys: rows by bucket of their own digest, beyond the buckets of keys, so that one key never meets in one task."""
    view, digest = memoryview(s.raw), xxhash.xxh3_128_digest
    found = np.empty((len(at), 2), np.uint64)
    for a in range(0, len(at), BLOCK):
        found[a : a + BLOCK] = np.frombuffer(b"".join([digest(view[p : p + WIDTH]) for p in at[a : a + BLOCK].tolist()]), np.uint64).reshape(-1, 2)
    bucket = buckets + bucket_of(found[:, 0], buckets)
    order = np.argsort(bucket, kind="stable")
    at, found = at[order], found[order]
    doc = s.doc_id[np.searchsorted(s.start, at, side="right") - 1]
    return [(mine, b, at[a:z].astype(np.int64).tobytes(), b"", doc[a:z].tobytes(), found[a:z].tobytes(), b"") for b, (a, z) in ends_of(bucket[order]).items()]


def least_of_digests(group: pa.Table) -> pa.Table:
    """Windows whose digest a smaller document holds, as runs."""
    start, row = unpack(group, "start", np.int64)
    doc, _ = unpack(group, "doc", np.int64)
    digest, _ = unpack(group, "key", np.dtype((np.uint64, 2)))
    order = np.lexsort((doc, digest[:, 1], digest[:, 0]))
    d = digest[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]).any(1)
    least = np.empty(len(d), np.int64)
    least[order] = doc[order][new][np.cumsum(new) - 1]
    gone = least < doc
    row, start = row[gone], start[gone]
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))) if len(row) else np.empty(0, np.int64)
    return by_shard(group, row[head], start[head], np.diff(np.append(head, len(row))))


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sharded documents and, by shard, packed runs of windows (start in the shard's bytes, count) that an earlier document has."""
    plain, _, total = sharded(docs)
    buckets = parts(total, BUCKET)

    def offer(group: pa.Table) -> pa.Table:
        """Distinct keys, 32 bits beside the bucket, and how many runs each has."""
        w = Windows(Shard(group, WIDTH), buckets)
        key = w.distinct.astype(np.uint32)
        out = {KEY: pa.array(np.full(len(w.ends), group[KEY][0].as_py()), pa.int32()), "bucket": pa.array(list(w.ends), pa.int32())}
        return pa.table(out | {n: pa.array([v[a:z].tobytes() for a, z in w.ends.values()], pa.binary()) for n, v in (("key", key), ("held", w.held))})

    def share(group: pa.Table) -> pa.Table:
        """For each offered key 1 where several documents hold it, 2 where it is hot besides. Chance equals of 32 bits cost work, not results."""
        key, row = unpack(group, "key", np.uint32)
        held, _ = unpack(group, "held", np.uint8)
        order = np.argsort(key, kind="stable")
        k, n = key[order], held[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(first, len(k)))
        runs_ = np.add.reduceat(np.maximum(n, 1), first)
        says = np.where((size > 1) | (np.maximum.reduceat(n, first) > 0), np.where(runs_ > HOT, 2, 1), 0).astype(np.uint8)
        told = np.empty(len(k), np.uint8)
        told[order] = np.repeat(says, size)
        ends = np.searchsorted(row, np.arange(group.num_rows + 1))
        return pa.table({KEY: group[KEY], "bucket": group["bucket"], "told": pa.array([told[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    def sort_shard(group: pa.Table, answers: pa.Table) -> pa.Table:
        """The shard's suffix array over places with shared keys: later documents' windows are settled, the others go out."""
        if not group.num_rows:
            return out_table([])
        s = Shard(in_order(group), WIDTH)
        w = Windows(s, buckets)
        mine = group[KEY][0].as_py()
        told = np.zeros(len(w.distinct), np.uint8)
        for b, says in zip(answers["bucket"].to_pylist(), answers["told"].to_pylist(), strict=True):
            told[slice(*w.ends[b])] = np.frombuffer(says, np.uint8)
        pick = told[w.of] > 0
        window = marked(len(s.data), w.start[pick], (w.start + w.count)[pick])
        start, count = runs(window)
        if not len(start):
            return out_table([])
        covered = marked(len(s.data), start, start + count + WIDTH - 1)
        group_of = equal_windows(s.data[covered], window[covered], WIDTH)
        del covered
        # rows are in order of id: documents by their rank, a row's windows are neighbours
        rank = np.cumsum(np.concatenate(([False], s.doc_id[1:] != s.doc_id[:-1])), dtype=np.int32)
        at = np.flatnonzero(window)
        doc = np.repeat(rank, np.diff(np.append(np.searchsorted(at, s.start), len(at))))
        least = np.full(group_of.max() + 1, np.iinfo(np.int32).max, np.int32)
        np.minimum.at(least, group_of, doc)
        first = doc == least[group_of]
        del group_of, doc, least
        hot = np.repeat(told[w.of[pick]] == 2, w.count[pick])
        rows = by_digest(s, mine, at[first & hot], buckets)
        window[at[~first]] = False
        start, count = runs(marked(len(s.data), w.start[pick], (w.start + w.count)[pick]) & ~window)
        rows += [(mine, -1 - mine, start.astype(np.int64).tobytes(), count.astype(np.int64).tobytes(), b"", b"", b"")] if len(start) else []
        window[at[hot]] = False
        del at, first, hot
        start, count = runs(window, w.key_at)
        key = w.key_at[start]
        bucket = bucket_of(key, buckets)
        order = np.lexsort((key, bucket))
        start, count, key, bucket = start[order], count[order], key[order], bucket[order]
        doc = s.doc_id[np.searchsorted(s.start, start, side="right") - 1]
        for b, ends in ends_of(bucket).items():
            own = slice(*ends)
            text = b"".join([s.raw[p : p + c + WIDTH - 1] for p, c in zip(start[own].tolist(), count[own].tolist(), strict=True)])
            rows.append((mine, b, start[own].astype(np.int64).tobytes(), count[own].astype(np.int64).tobytes(), doc[own].tobytes(), key[own].tobytes(), text))
        return out_table(rows)

    def merge(group: pa.Table) -> pa.Table:
        """Runs of all shards that hold a bucket's keys. Settled ones pass through."""
        if group["bucket"][0].as_py() < 0:
            return group.select([KEY, "start", "count"])
        if group["bucket"][0].as_py() >= buckets:
            return least_of_digests(group)
        start, row = unpack(group, "start", np.int64)
        count, _ = unpack(group, "count", np.int64)
        doc, _ = unpack(group, "doc", np.int64)
        key, _ = unpack(group, "key", np.uint64)
        raw = b"".join([t.as_buffer() for t in group["text"]])
        run, step, n = earlier_runs(raw, count, doc, key)
        return by_shard(group, row[run], start[run] + step, n)

    kinds = [(KEY, pa.int32()), ("bucket", pa.int32()), ("start", pa.binary()), ("count", pa.binary()), ("doc", pa.binary()), ("key", pa.binary()), ("text", pa.binary())]

    def out_table(rows: list[tuple]) -> pa.Table:
        cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

    offered = plain.groupBy(KEY).applyInArrow(offer, f"{KEY} int, bucket int, key binary, held binary")
    shared = offered.groupBy("bucket").applyInArrow(share, f"{KEY} int, bucket int, told binary")
    sent = plain.groupBy(KEY).cogroup(shared.groupBy(KEY)).applyInArrow(sort_shard, f"{KEY} int, bucket int, start binary, count binary, doc binary, key binary, text binary")
    return plain, sent.groupBy("bucket").applyInArrow(merge, f"{KEY} int, start binary, count binary")


def suffix_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed_spans (bytes), kept_sha256 and, with_text, kept (binary: a cut may split a letter).

    A byte goes if a 50-byte string over it also starts in a document with a smaller id, judged on the input. A null text
    is empty; a null id counts as the largest; rows that repeat an id do not remove each other's bytes; texts under 50
    bytes are whole. An empty table gives an empty result.

    1. Each window of 50 bytes has a key, the least hash of its 16-byte grams, which its neighbours mostly share. Shards
    offer their distinct keys, buckets answer which ones several documents hold: all other windows are unique.
    2. Each shard builds a suffix array (Larsson-Sadakane) over the bytes below shared keys. A window that a
    smaller document of the shard has is settled there, so copies inside a shard never travel.
    3. The other runs of windows go to their key's bucket. There shards merge, a slice of keys at a time: equal texts by
    their bytes, and where a key has several texts, by a suffix array over those. A key of more than HOT runs, as of a
    line that a third of all documents hold, does not meet in one place: its windows go out by their own 128-bit digests.
    """
    plain, found = repeated_windows(docs)

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        group = in_order(group)
        s = Shard(group, WIDTH)
        start, _ = unpack(answers, "start", np.int64)
        count, _ = unpack(answers, "count", np.int64)
        return pa.table({"doc_id": group["doc_id"]} | s.cover(marked(len(s.data), start, start + count + WIDTH - 1), group, with_text))

    schema = f"doc_id long, n_bytes long, n_removed long, removed_spans {SPANS_SQL}, kept_sha256 string" + ", kept binary" * with_text
    return plain.groupBy(KEY).cogroup(found.groupBy(KEY)).applyInArrow(finish, schema)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), with_text=False)
    # chance repeats of 50 bytes go as well; n_long counts the bytes of removed runs that are as long as a passage
    long = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + F.when(s["length"] >= LONG, s["length"]).otherwise(0))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), "kept_sha256", long.alias("n_long"))

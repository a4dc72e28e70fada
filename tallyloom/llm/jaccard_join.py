"""N-gram Jaccard join (8): rare-first prefixes with length, positional and suffix filters; each pair is verified once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fresh, parts, table
from .components import components
from .shards import KEY, ends_of, sharded, unpack

#: Words of a shingle; similarity in hundredths; tokens held by up to ALL classes propose all pairs of those; text of a bucket,
#: about; salts of a hot key; pairs of a set beyond which it is hot, or this part of all pairs; members of a block of a group that is left.
WIDTH, LEAST, ALL, BUCKET, SALTS, HOT, MOST, BLOCK = 5, 75, 8, 16 << 20, 64, 256, 1 << 16, 2048
#: Fixed odd factors, one for each word of a shingle, and words that a worker remembers.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
WORDS = 150_000


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS:
            self[word] = h
        return h


HASHES = WordHash()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z in lower case, words between ASCII white space."""
    got = text.encode().lower().split()
    if not got:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(HASHES.__getitem__, got), np.uint64, len(got))
    if len(w) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(w.tobytes(), seed=len(w))], np.uint64)
    h = sum((w[k : len(w) - WIDTH + 1 + k] * FACTORS[k] for k in range(WIDTH)), np.uint64(0))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def at_least(n: np.ndarray) -> np.ndarray:
    """Shared shingles that a set of n needs with any partner."""
    return -(-LEAST * n // 100)


def shared_prefix(n: np.ndarray) -> np.ndarray:
    """Tokens by which a prefix is longer than one that would share a single token with any partner, plus that one."""
    return 1 + n // 10


def overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shared shingles that sets of n and m need: 100 * i >= LEAST * (n + m - i)."""
    return -(-LEAST * (n + m) // (100 + LEAST))


def level(count: np.ndarray) -> np.ndarray:
    """A byte that grows with a count: itself up to 127, then by its logarithm."""
    return np.where(count < 128, count, np.minimum(128 + 8 * np.log2(np.maximum(count, 1) / 128), 255)).astype(np.uint8)


class Tokens:
    """Classes of a shard (rows with one set count once, by a 128-bit digest, in its order) and their tokens, grouped by bucket and token."""

    def __init__(self, group: pa.Table, buckets: int):
        sets: dict[bytes, np.ndarray] = {}
        mine = []
        for t in group["text"]:
            s = shingles(t.as_py())
            mine.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"")
            if len(s):
                sets.setdefault(mine[-1], s)
        names = sorted(sets)
        place = {d: k for k, d in enumerate(names)}
        self.row = np.fromiter((place.get(d, -1) for d in mine), np.int64, len(mine))
        self.sets = [sets[d] for d in names]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.digest = np.frombuffer(b"".join(names), ">u8").reshape(-1, 2).astype(np.uint64)
        self.class_ends = ends_of(bucket_of(self.digest[:, 0], buckets))
        token = np.concatenate([*self.sets, np.empty(0, np.uint64)])
        # the bucket is a range of the token, so one sort groups both
        order = np.argsort(token, kind="stable")
        self.token, self.of = token[order], np.repeat(np.arange(len(self.n)), self.n)[order]
        new = np.ones(len(order), bool)
        new[1:] = self.token[1:] != self.token[:-1]
        self.first, self.distinct_of = np.flatnonzero(new), np.cumsum(new) - 1
        self.ends = ends_of(bucket_of(self.token[self.first], buckets))

    def prefixes(self, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of token, of) in the rare-first prefix of their class, and their places in its order. rare: of each distinct token."""
        order = np.lexsort((self.token, rare[self.distinct_of], self.of))
        place = np.arange(len(order)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        inside = place < np.repeat(self.n - at_least(self.n) + shared_prefix(self.n), self.n)
        return order[inside], place[inside]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: What a shard returns, all in one table: rows of documents, entries of rare tokens by bucket, entries of common ones, sets.
DOCUMENT, RARE, COMMON, SET = range(4)
KINDS = {"kind": pa.int8(), "doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "bucket": pa.int32(), "tokens": pa.binary(), "nodes": pa.binary(), "sizes": pa.binary(), "places": pa.binary(), "commons": pa.binary(), "token": pa.int64(), "middle": pa.float64(), "shingles": pa.binary(), "rare": pa.binary(), "h": pa.int64()}


def typed(kind: int, rows: int, **columns) -> pa.Table:
    """Rows of a kind; columns that are not given are null."""
    given = {k: v if isinstance(v, pa.Array) else pa.array(v, KINDS[k]) for k, v in columns.items()} | {"kind": pa.array(np.full(rows, kind), pa.int8())}
    return pa.table({k: given[k] if k in given else pa.nulls(rows, t) for k, t in KINDS.items()})


def entries(docs: DataFrame) -> DataFrame:
    """The written table of KINDS. A node stands for a set: the shard that owns it, the smallest that holds it, and its place there."""
    plain, _, total = sharded(docs)
    plain = plain.withColumn("h", F.xxhash64("text"))
    buckets = parts(total, BUCKET)

    def offer(group: pa.Table) -> pa.Table:
        """By bucket: distinct tokens, 32 bits beside the bucket, and how many classes of the shard hold each, 255 at most; digests of classes and the place of the first."""
        fresh()
        p = Tokens(group, buckets)
        held = np.minimum(np.diff(np.append(p.first, len(p.token))), 255).astype(np.uint8)
        key, rows = p.token[p.first].astype(np.uint32), []
        for b in sorted(p.ends.keys() | p.class_ends.keys()):
            (a, z), (c, e) = p.ends.get(b, (0, 0)), p.class_ends.get(b, (0, 0))
            rows.append((b, key[a:z].tobytes(), held[a:z].tobytes(), c, p.digest[c:e].tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        out = {KEY: pa.array(np.full(len(rows), group[KEY][0].as_py()), pa.int32())}
        return pa.table(out | {n: pa.array(c, t) for n, t, c in zip(("bucket", "key", "held", "base", "digest"), (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()), cols, strict=True)})

    def share(group: pa.Table) -> pa.Table:
        """The level of each offered token's count over all shards, and the node of each digest. Chance equals of 32 bits have one level everywhere."""
        key, row = unpack(group, "key", np.uint32)
        held, _ = unpack(group, "held", np.uint8)
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
        sums = level(np.add.reduceat(held[order].astype(np.int64), first)) if len(k) else np.empty(0, np.uint8)
        levels = np.empty(len(k), np.uint8)
        levels[order] = np.repeat(sums, np.diff(np.append(first, len(k))))
        digest, of = unpack(group, "digest", np.dtype((np.uint64, 2)))
        own = (group[KEY].to_numpy().astype(np.int64)[of] << 32) + group["base"].to_numpy()[of] + np.arange(len(of)) - np.searchsorted(of, of)
        order = np.lexsort((own, digest[:, 1], digest[:, 0]))
        d = digest[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]).any(1)
        node = np.empty(len(d), np.int64)
        node[order] = own[order][new][np.cumsum(new) - 1]
        each = np.arange(group.num_rows + 1)
        ends, tops = np.searchsorted(row, each), np.searchsorted(of, each)
        cut_ = lambda v, e: pa.array([v[a:b].tobytes() for a, b in zip(e[:-1], e[1:], strict=True)], pa.binary())
        return pa.table({KEY: group[KEY], "bucket": group["bucket"], "levels": cut_(levels, ends), "owners": cut_(node, tops)})

    def enter(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return typed(DOCUMENT, 0)
        p, shard = Tokens(group, buckets), group[KEY][0].as_py()
        rare, node = np.zeros(len(p.first), np.uint8), np.zeros(len(p.n), np.int64)
        for b, levels, owners in zip(answers["bucket"].to_pylist(), answers["levels"].to_pylist(), answers["owners"].to_pylist(), strict=True):
            (a, z), (c, e) = p.ends.get(b, (0, 0)), p.class_ends.get(b, (0, 0))
            rare[a:z], node[c:e] = np.frombuffer(levels, np.uint8), np.frombuffer(owners, np.int64)
        has = p.row >= 0
        padded = np.append(node, 0)[p.row]
        out = [typed(DOCUMENT, len(has), doc_id=group["doc_id"].combine_chunks(), n=np.append(p.n, 0)[p.row], node=pa.array(padded, pa.int64(), mask=~has), h=group["h"].combine_chunks())]
        on, place = p.prefixes(rare)
        shared = (rare[p.distinct_of[on]] > 1) & (node == (shard << 32) + np.arange(len(node)))[p.of[on]]
        on, place = on[shared], place[shared]
        # a partner has LEAST of the size at least and shares its shared_prefix of tokens or more
        enough = np.bincount(p.of[on], minlength=len(p.n)) >= shared_prefix(LEAST * p.n // 100)
        keep = enough[p.of[on]]
        on, place = on[keep], place[keep]
        of, few = p.of[on], rare[p.distinct_of[on]] <= ALL
        common = np.bincount(of[~few], minlength=len(p.n))
        # the mean level of a class is largest where its tokens are the commonest: in the middle of a family of copies
        middle = np.bincount(p.of, rare[p.distinct_of], len(p.n)) / np.maximum(p.n, 1) + (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.float64) * 1e-12
        out.append(typed(COMMON, int((~few).sum()), token=p.token[on[~few]].view(np.int64), node=node[of[~few]], n=p.n[of[~few]], middle=middle[of[~few]]))
        on, place, of = on[few], place[few], of[few]
        order = np.argsort(p.token[on], kind="stable")
        on, place, of = on[order], place[order], of[order]
        packed = {"tokens": p.token[on], "nodes": node[of], "sizes": p.n[of].astype(np.uint32), "places": place.astype(np.uint32), "commons": common[of].astype(np.uint32)}
        ends = ends_of(bucket_of(p.token[on], buckets))
        out.append(typed(RARE, len(ends), bucket=list(ends), **{c: [v[a:z].tobytes() for a, z in ends.values()] for c, v in packed.items()}))
        used = np.flatnonzero(enough & (np.bincount(p.of[on], minlength=len(p.n)) + common > 0))
        seldom = np.zeros(len(p.token), bool)
        seldom[:] = rare[p.distinct_of] <= ALL
        by_class = np.lexsort((p.token, p.of))
        base = np.cumsum(p.n) - p.n
        bits = [np.packbits(seldom[by_class[base[k] : base[k] + p.n[k]]]).tobytes() for k in used]
        out.append(typed(SET, len(used), node=node[used], n=p.n[used], shingles=[p.sets[k].tobytes() for k in used], rare=bits))
        return pa.concat_tables(out)

    sql = {pa.int8(): "byte", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary"}
    offered = plain.groupBy(KEY).applyInArrow(offer, f"{KEY} int, bucket int, key binary, held binary, base long, digest binary")
    shared = offered.groupBy("bucket").applyInArrow(share, f"{KEY} int, bucket int, levels binary, owners binary")
    return cut(plain.groupBy(KEY).cogroup(shared.groupBy(KEY)).applyInArrow(enter, ", ".join(f"{k} {sql[t]}" for k, t in KINDS.items())))


def fits(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length and positional filters for sets of n and m that share the tokens at places i and j of their order."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    return (100 * low >= LEAST * high) & (1 + np.minimum(n - i, m - j) - 1 + np.minimum(i, j) >= overlap(n, m))


def propose(group: pa.Table) -> pa.Table:
    """Pairs of a bucket's rare tokens, at most ALL to a token: tokens shared here, tokens needed, common tokens that may be shared besides."""
    (token, _), (c, _) = unpack(group, "tokens", np.uint64), unpack(group, "nodes", np.int64)
    n, i, more = (unpack(group, x, np.uint32)[0].astype(np.int64) for x in ("sizes", "places", "commons"))
    order = np.lexsort((c, token))
    token, c, n, i, more = token[order], c[order], n[order], i[order], more[order]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, ALL):
        at = np.flatnonzero(token[d:] == token[:-d])
        a.append(at)
        b.append(at + d)
    a, b = np.concatenate(a), np.concatenate(b)
    ok = fits(n[a], n[b], i[a], i[b])
    return counted(c, n, more, a[ok], b[ok])


def counted(c: np.ndarray, n: np.ndarray, more: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Distinct pairs x < y of places a and b with the tokens they share here (k), need to share, and may share besides."""
    x, y = np.minimum(c[a], c[b]), np.maximum(c[a], c[b])
    order = np.lexsort((y, x))
    x, y, a, b = x[order], y[order], a[order], b[order]
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.empty(0, np.int64)
    k = np.diff(np.append(first, len(x)))
    a, b = a[first], b[first]
    return pa.table({"x": x[first], "y": y[first], "k": k, "need": shared_prefix(np.minimum(n[a], n[b])), "more": np.minimum(more[a], more[b])})


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """Verify a pair of sorted sets; the suffix filter first bounds the overlap by counts in ranges of hashes."""
    need = int(overlap(np.int64(len(s)), np.int64(len(t))))
    edges = np.arange(1, 64, dtype=np.uint64) << np.uint64(58)
    p, q = (np.diff(np.concatenate(([0], np.searchsorted(v, edges), [len(v)]))) for v in (s, t))
    if int(np.minimum(p, q).sum()) < need:
        return False
    at = np.searchsorted(t, s)
    return int((t[np.minimum(at, len(t) - 1)] == s).sum()) >= need


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y of written pairs with the sets of both, s and t. Sets go through one exchange that both ends read.

    A node of more than HOT pairs meets them in SALTS places. The list of those nodes is broadcast, so that it costs the sets
    no exchange; it has 2 * MOST nodes at most, whatever the number of pairs.
    """
    ends = pairs.select(F.explode(F.array("x", "y")).alias("node"))
    least = max(HOT, pairs.count() // MOST)
    hot = ends.groupBy("node").count().filter(F.col("count") > least).select("node", F.lit(SALTS - 1).alias("top"))
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))).alias("salt")
    copies = sets.join(F.broadcast(hot), "node", "left").select("node", salts, F.struct("shingles", "rare").alias("set"))
    for end, other, name in (("x", "y", "s"), ("y", "x", "t")):
        salt = F.when(F.col("top").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
        dealt = pairs.join(F.broadcast(hot.withColumnRenamed("node", end)), end, "left").withColumn("salt", salt).drop("top")
        pairs = dealt.join(copies.withColumnsRenamed({"node": end, "set": name}), [end, "salt"]).drop("salt")
    return pairs


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link."""

    def run(batches):
        for b in batches:
            s, t = ([np.frombuffer(v.as_py(), np.uint64) for v in b.column(k).field("shingles")] for k in ("s", "t"))
            yield b.select(["x", "y"]).filter(pa.array([linked(p, q) for p, q in zip(s, t, strict=True)], pa.bool_()))

    return with_sets(pairs, sets).select("x", "y", "s", "t").mapInArrow(run, "x long, y long")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, lost (shingles of y that x lacks), own (common ones of x that y lacks), linked; written."""

    def run(batches):
        for b in batches:
            out = []
            for s, t, rare in zip(b.column("s").field("shingles"), b.column("t").field("shingles"), b.column("s").field("rare"), strict=True):
                s, t = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                both = t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s
                few = np.unpackbits(np.frombuffer(rare.as_py(), np.uint8), count=len(s)).astype(bool)
                k = int(both.sum())
                out.append((len(t) - k, int((~both & ~few).sum()), k >= overlap(len(s), len(t))))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], ["x", "y", "lost", "own", "linked"])

    return cut(with_sets(pairs, sets).select("x", "y", "s", "t").mapInArrow(run, "x long, y long, lost long, own long, linked boolean"))


def possible(p: np.ndarray, n: np.ndarray, m: np.ndarray, lost: np.ndarray, lost_m: np.ndarray, own: np.ndarray, own_m: np.ndarray) -> np.ndarray:
    """May two sets link that share no rare token? Of their centre's p shingles they share those neither lost, beside it common ones of their own."""
    return (100 * np.minimum(n, m) >= LEAST * np.maximum(n, m)) & (p - np.maximum(lost, lost_m) + np.minimum(own, own_m) >= overlap(n, m))


def pair_cells(group: pa.Table) -> pa.Table:
    """Cells of a token's group that may hold a link between two components, in pairs, each in blocks of at most about BLOCK members."""
    p, low, high, lost, own, a, z, count = (group[c].to_numpy() for c in ("p", "low", "high", "lost", "own", "least", "most", "count"))
    i, j = np.triu_indices(len(p))
    # the most favourable sizes: n and m as alike as their ranges allow, as small as they come
    n, m = np.maximum(low[i], np.minimum(high[i], low[j])), np.maximum(low[j], np.minimum(high[j], low[i]))
    size = 100 * np.minimum(n, m) >= LEAST * np.maximum(n, m)
    ok = size & (p[i] - np.maximum(lost[i], lost[j]) + np.minimum(own[i], own[j]) >= overlap(low[i], low[j])) & ~((a[i] == z[i]) & (a[j] == z[j]) & (a[i] == a[j]))
    rows = []
    blocks = -(-count // BLOCK)
    for k, (x, y) in enumerate(zip(i[ok].tolist(), j[ok].tolist(), strict=True)):
        for s in range(int(blocks[x])):
            for t in range(s if x == y else 0, int(blocks[y])):
                rows += [(k, s, t, x, s, 0)] + [(k, s, t, y, t, 1)] * ((x, s) != (y, t))
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    at = np.array(cols[3], np.int64)
    cells = {c: group[c].take(pa.array(at)) for c in ("token", "cn", "cl", "co")}
    return pa.table(cells | {"blocks": pa.array(blocks[at], pa.int64())} | {c: pa.array(v, pa.int64()) for c, v in zip(("pair", "s", "t", "block", "side"), (cols[0], cols[1], cols[2], cols[4], cols[5]), strict=True)})


def across(group: pa.Table) -> pa.Table:
    """Pairs of two blocks, or within one, that the filters leave and that lie in two components."""
    c, n, r, lost, own, side = (group[x].to_numpy() for x in ("node", "n", "root", "lost", "own", "side"))
    p = group["p"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one = not len(right)
    if one:
        right = left
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at, k in enumerate(left.tolist()):
        to = right[at + 1 :] if one else right
        to = to[(r[to] != r[k]) & possible(p[to], n[to], n[k], lost[to], lost[k], own[to], own[k])]
        a.append(np.full(len(to), k))
        b.append(to)
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"x": np.minimum(c[a], c[b]), "y": np.maximum(c[a], c[b]), "need": shared_prefix(np.minimum(n[a], n[b]))})


def apart(members: DataFrame, compared: DataFrame, roots: DataFrame) -> DataFrame:
    """x, y: pairs of common tokens' groups that may link and lie in two components; they share no rare token.

    A member is known by what it lost of its group's centre and by what it has beside it. Members with like figures are a
    cell; only cells that may link, and do not lie in one component, bring their members together, block by block.
    """
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("token")
    known = compared.select(F.col("x").alias("node"), F.col("y").alias("centre"), "lost", "own")
    rows = rooted.join(mixed, "token", "left_semi").join(known, ["node", "centre"], "left")
    # a member that the length filter kept from its centre may have anything
    lost = F.when(F.col("node") == F.col("centre"), 0).otherwise(F.coalesce("lost", F.greatest(F.col("p") - F.col("n"), F.lit(0))))
    own = F.when(F.col("node") == F.col("centre"), 0).otherwise(F.coalesce("own", "n"))
    rows = rows.withColumn("lost", lost.cast("long")).withColumn("own", own.cast("long"))
    step = lambda v: F.floor(F.col(v) * 32 / F.col("n")).cast("long")
    rows = cut(rows.select("token", "node", "n", "root", "p", "lost", "own", F.floor(F.log2("n") * 16).cast("long").alias("cn"), step("lost").alias("cl"), step("own").alias("co")))
    cells = rows.groupBy("token", "cn", "cl", "co").agg(F.max("p").alias("p"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("lost").alias("lost"), F.max("own").alias("own"), F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("count"))
    pairs = cells.groupBy("token").applyInArrow(pair_cells, "token long, cn long, cl long, co long, blocks long, pair long, s long, t long, block long, side long")
    here = F.pmod(F.xxhash64("node"), F.col("blocks")) == F.col("block")
    meet = rows.join(pairs, ["token", "cn", "cl", "co"]).filter(here)
    found = meet.groupBy("token", "pair", "s", "t").applyInArrow(across, "x long, y long, need long")
    return found.groupBy("x", "y").agg(F.count("*").alias("k"), F.max("need").alias("need")).filter("k >= need").select("x", "y")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), h (hash of the text), one row per input row.

    A null text is empty; texts without words have no shingle and link with nothing: their component is their own id. Under
    five words the sequence is the one shingle. Rows with equal sets are one node, found by a 128-bit digest. A null id is
    never the smallest of a component that has another. Shingles are compared by 64-bit hashes.

    Order of tokens: by how many classes of all shards hold them, then by hash. Shards offer their distinct tokens, buckets
    answer with the counts, and only prefix tokens that several hold become entries. A prefix is longer by a tenth of the
    set than one token in common asks for, so a pair must share that many (Wang, Li and Feng, 2012), and a passage in
    common makes no candidate.

    Tokens of at most ALL classes propose every pair. In the group of a commoner token only the centre, the member whose
    tokens are the commonest, meets the others, so a family of copies makes a linear number of pairs. Pairs that still lie
    in two components share common tokens alone; what both lost of the centre and have beside it bounds what they can
    share, and the few that pass are verified too. So no link is lost and large groups never expand into pairs.
    """
    table_ = entries(docs)
    of = lambda kind: table_.filter(F.col("kind") == kind)
    sets = of(SET).select("node", "shingles", "rare")
    rare = of(RARE).select("bucket", "tokens", "nodes", "sizes", "places", "commons").groupBy("bucket").applyInArrow(propose, "x long, y long, k long, need long, more long")
    rare = cut(rare.groupBy("x", "y").agg(F.sum("k").alias("k"), F.max("need").alias("need"), F.max("more").alias("more")))
    common = of(COMMON).select("token", "node", "n", "middle")
    centres = common.groupBy("token").agg(F.max_by("node", "middle").alias("centre"), F.max_by("n", "middle").alias("p"), F.count("*").alias("held")).filter("held > 1").drop("held")
    members = cut(common.drop("middle").join(centres, "token"))
    alike = 100 * F.least("n", "p") >= LEAST * F.greatest("n", "p")
    spokes = members.filter((F.col("node") != F.col("centre")) & alike).select(F.col("node").alias("x"), F.col("centre").alias("y")).distinct()
    # a pair that is a spoke either way round is compared as one
    other = rare.filter("k + more >= need").select("x", "y")
    for x, y in (("x", "y"), ("y", "x")):
        other = other.join(spokes.select(F.col("x").alias(x), F.col("y").alias(y)), ["x", "y"], "left_anti")
    met = cut(other.union(spokes))
    compared = compare(met, sets)
    roots = components(compared.filter("linked"))
    rest = apart(members, compared, roots).join(rare, ["x", "y"], "left_anti")
    for x, y in (("x", "y"), ("y", "x")):
        rest = rest.join(compared.select(F.col("x").alias(x), F.col("y").alias(y)), ["x", "y"], "left_anti")
    rest = cut(rest)
    # without pairs no set moves
    later = cut(verify(rest, sets)) if rest.head(1) else rest
    if later.head(1):
        roots = components(later.union(roots.filter("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y"))))
    discard(rare, members, met, compared, rest, later)
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    salts = lambda c: F.bit_or(F.expr(f"shiftleft(1L, {c})"))
    spread_ = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("salts", k) == 1))
    rows = of(DOCUMENT).select("doc_id", "n", "node", "h").withColumn("s", salt("doc_id"))
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), salts("s").alias("salts"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("rs", salt("node"))
    # the smallest id of a component returns to its nodes, and from those to the rows, by salt: a hot one is dealt out
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), salts("rs").alias("salts")).select("root", "component_id", spread_.alias("rs"))
    answer = rooted.join(least, ["root", "rs"]).select("node", "component_id", spread_.alias("s"))
    out = rows.join(answer, ["node", "s"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "h")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of their component; rows that repeat that id there all stay."""
    best = jaccard_components(docs).filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__h"))
    return docs.join(best, mine, "left_semi")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("h")

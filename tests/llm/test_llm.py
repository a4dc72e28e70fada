"""Operators of the llm subpackage against libraries, brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import byte_bpe, chat_format, chunk_dedup, curves, exact_dedup, jaccard_join, neighbours, packing, registry, shards, suffix_dedup, suffixes, token_counts, toxicity, word_bpe

SMALL = "/root/testdata/sf0.001"
WORD = public.path("word_bpe_49k.json")
ODD = ["", None, "a", "x" * 3000, "  two  spaces\n\n\nlines ", "<|endoftext|> <|STARTOFTEXT|>", "Ünïcode ΟΔΟΣ İ é ́ 1a2b3 don't", "日本語 текст \U0001f600", "a\x1cb\x85c d", "!!! ### </turn> \\h"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)]
    rows += [(100, "same text", "en", "s"), (101, "same text", "en", "s"), (101, "same text", "en", "s"), (None, "same text", "en", "s"), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, and long texts; small shards make them cross."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, out = text(60), []
    for i in range(120):
        t = text(rng.randint(1, 120))
        if i % 6 == 0:
            t += " " + passage + " " + text(5)
        if i % 5 == 0 and out:
            t = rng.choice(out)
        if i % 7 == 0 and out:
            t = rng.choice(out) + " more"
        out.append(t)
    out += ["near " + out[1] + f" tail{i}" for i in range(25)] + [text(4000), "aaaa " * 300, "a" * 500, "a" * 500]
    return out


@pytest.fixture(scope="module")
def frame(spark, corpus):
    return spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").repartition(5)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(shards, "SHARD", 6000)
    for m in (chunk_dedup, suffix_dedup, jaccard_join):
        monkeypatch.setattr(m, "BUCKET", 9000)


def texts(df):
    return [r.text or "" for r in df.collect()]


def encoder():
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(docs, frame, empty):
    e = encoder()
    for df in (docs, frame):
        want = Counter((r.doc_id, tuple(e.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in df.collect())
        got = byte_bpe.encode_decode(df, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).collect()
        assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
        assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in got)
    assert byte_bpe.encode_decode(empty, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).count() == 0


def test_byte_bpe_of_long_words():
    """Words whose recursive query would keep too many steps: side by side, in bounded memory, as the library has them."""
    b, e = byte_bpe.load(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN), encoder()
    rng = random.Random(6)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(n))
    words = ["abcabcab" * 40, *["a" * k for k in range(60, 140, 3)], "aab" * 50, "é" * 100, "日本語" * 60, letters(30_000), letters(9000, "ab")]
    words += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000)), *[letters(390) for _ in range(500)]]
    got = b.merged(words)
    for w in words:
        assert got[w] == ",".join(map(str, e.encode_ordinary(w))), w[:20]
    million = letters(1_000_000)
    assert b.merged([million])[million] == ",".join(map(str, e.encode_ordinary(million)))


def test_long_words_of_the_other_tokenizer():
    b, t, rng = word_bpe.load(WORD), Tokenizer.from_file(WORD), random.Random(8)
    for n in (40, 60, 300, 3000, 200_000):
        for of in ("a", "ab", "abcdefghijklmnopqrstuvwxyz"):
            w = "".join(rng.choice(of) for _ in range(n))
            assert [b.vocab[s] for s in b.merge(w)] == t.encode(w, add_special_tokens=False).ids


def test_token_counts_equal_the_library(docs, frame, empty):
    t = Tokenizer.from_file(WORD)
    for df in (docs, frame):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert Counter(map(tuple, token_counts.token_counts(df, WORD).collect())) == want
    assert token_counts.token_counts(empty, WORD).count() == 0


def test_whole_tokens_are_proved():
    b, t = word_bpe.load(WORD), Tokenizer.from_file(WORD)
    whole = b.whole_tokens()
    assert len(whole) > 30_000 and "the" in whole
    for w in random.Random(1).sample(sorted(whole), 500):
        assert len(t.encode(w, add_special_tokens=False).ids) == 1


def test_packing_places_every_id_once(docs, frame, empty):
    t = Tokenizer.from_file(WORD)
    for df, room in ((docs, 2048), (frame, 100)):
        got = packing.pack_documents(df, WORD, room).collect()
        bins, by_doc = defaultdict(list), defaultdict(list)
        for r in got:
            ids = np.frombuffer(r.ids, "<u4")
            assert len(ids) == r.length <= room and zlib.crc32(r.ids) == r.ids_crc32
            bins[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id].append((r.piece, r.start, ids.tolist()))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= room
        for r in df.filter("doc_id IS NOT NULL AND doc_id <> 101").collect():
            whole = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
            assert sorted(by_doc[r.doc_id]) == [(k // room, k, whole[k : k + room]) for k in range(0, len(whole), room)]
    assert packing.pack_documents(empty, WORD).count() == 0


def test_plans_use_each_item_once_and_stay_near_the_bound():
    rng = random.Random(2)
    for _ in range(300):
        room = rng.choice([10, 64, 2048])
        c = Counter(rng.randint(1, rng.choice([room, room // 2])) for _ in range(rng.choice([1, 2, 7, 60, 400])))
        used = Counter()
        sets = packing.plan(c, room)
        for items, times in sets:
            assert sum(items) <= room and times > 0
            for x in items:
                used[x] += times
        assert used == c
        assert sum(n for _, n in sets) <= 11 / 9 * -(-sum(k * v for k, v in c.items()) // room) + 4 + sum(v for k, v in c.items() if 2 * k > room)


def test_dominance_is_optimal_on_tiny_cases():
    def optimum(items, room):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in sorted(set(range(len(bins)))):
                if bins[k] + items[i] <= room:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    rng = random.Random(3)
    sizes = Counter()
    for _ in range(600):
        items = sorted((rng.randint(rng.randint(1, 4), rng.choice([6, 8, 12])) for _ in range(rng.randint(1, 9))), reverse=True)
        left = dict(Counter(items))
        fixed = packing.reduce_by_dominance(left, 12)
        sizes.update(len(s) for s, _ in fixed)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(n for _, n in fixed) + optimum(rest, 12) == optimum(items, 12)
    assert sizes[1] and sizes[2] and sizes[3] > 20


def test_hilbert_neighbours_touch():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = curves.hilbert_key(g, 3)
    assert sorted(k) == list(range(512)) and (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1) == 1).all()


def test_neighbours_reach_the_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(1)
    clone = [float(x) for x in rng.normal(size=64)]
    bad = spark.createDataFrame([(9_000_000 + 20 * i, v) for i, v in enumerate([None, [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 5])], "vec_id long, embedding array<float>")
    more = spark.createDataFrame([(8_000_000 + i, clone) for i in range(60)], "vec_id long, embedding array<float>")
    every = e.unionByName(more).unionByName(bad)
    rows = [(r.vec_id, r.embedding) for r in e.unionByName(more).collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = defaultdict(list)
    for r in neighbours.near_vectors(every).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, near in got.items():
        k = np.flatnonzero(ids == q)[0]
        s = x @ x[k]
        order = [int(i) for i in np.lexsort((ids, -s)) if i != k][:20]
        near.sort()
        assert [r for r, *_ in near] == list(range(1, 21))
        where = {int(v): i for i, v in enumerate(ids)}
        assert np.allclose([v for *_, v in near], [s[where[v]] for _, v, _ in near], atol=1e-12)
        assert near == sorted(near, key=lambda t: (-t[2], t[1]))
        hits += len({int(ids[i]) for i in order} & {v for _, v, _ in near})
    assert hits / (20 * len(got)) >= 0.9
    assert neighbours.near_vectors(bad.filter("vec_id < 9000060")).count() == 0
    assert neighbours.near_vectors(every.filter("false")).count() == 0


def test_exact_groups(docs, empty):
    got = Counter(map(tuple, exact_dedup.exact_groups(docs, "max").filter("group_size > 1").select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert got == Counter({(100, 101, 4, False): 1, (101, 101, 4, True): 2, (None, 101, 4, False): 1, (0, 1, 3, False): 1, (1, 1, 3, True): 1, (None, 1, 3, False): 1})
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.keep_one(docs.withColumn("h", F.lit(1)).withColumn("s", F.lit(2)))
    assert kept.columns == [*docs.columns, "h", "s"]
    assert Counter(r.text or "" for r in kept.collect()) == Counter(set(texts(docs)))


def test_chat_round_trip(spark):
    odd = [None, "", "\\", "\\h", "a</turn>\n### User: b", "### Assistant: x", "#", "</turn", ">", "x\\l:", "### ", "ünï\n"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant", "system", "=odd: role", None, "User"] * 2, odd))]
    rows += [(2, None, "assistant", "b"), (2, None, "assistant", "b"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.format_chats(df).collect():
        own = sorted(((t if t is not None else -1, a or "", b or "") for c, t, a, b in rows if c == r.conv_id))
        assert [(x.role, x.text) for x in r.turns] == [(a, b) for _, a, b in own]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        undo = lambda s: s.replace("\\c", ":").replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")
        assert len(spans) == sum(a == "assistant" for _, a, _ in own)
        for s, (_, _, b) in zip(spans, [x for x in own if x[1] == "assistant"]):
            assert b in (s, undo(s)) and "###" not in s and "</turn>" not in s
    assert chat_format.format_chats(df.filter("false")).count() == 0


def test_loss_columns_come_from_the_mask(spark, monkeypatch):
    """A mask that is off by one must show in the query's columns; the right one gives the assistants' texts."""
    want = defaultdict(str)
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn, r.role, r.text)):
        want[r.conv_id] += r.text if r.role == "assistant" else ""
    want[-7] = "\\### Assistant: </turn> ok"
    right = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat_format.op7_chat_format(spark, SMALL).collect()}
    assert right == {c: (len(t), hashlib.sha256(t.encode()).hexdigest()) for c, t in want.items()}
    whole = chat_format.format_chats
    off = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length")))
    monkeypatch.setattr(chat_format, "format_chats", lambda df: whole(df).withColumn("loss_spans", off))
    wrong = {r.conv_id: r.loss_sha256 for r in chat_format.op7_chat_format(spark, SMALL).collect()}
    assert all(wrong[c] != right[c][1] for c, t in want.items() if t)


def shingle_set(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_jaccard_components_equal_brute_force(spark, frame, corpus, small_shards, docs, empty):
    sets = [shingle_set(t) for t in corpus]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    out = jaccard_join.jaccard_components(docs).collect()
    assert len(out) == docs.count() and {r.component_id for r in out if r.doc_id in (100, 101)} == {100}
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.keep_representatives(frame.withColumn("c", F.lit(1)))
    assert {r.doc_id for r in kept.collect()} == {find(i) for i in range(len(sets))}


def test_large_groups_of_copies_stay_linear(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 999)}" for _ in range(60)]
    rows = []
    for i in range(200):
        w = list(base)
        w[rng.randrange(60)] = f"own{i}"
        rows.append((i, " ".join(w)))
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [shingle_set(t) for _, t in rows]
    linked = {i for i in range(1, 200) if any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(200) if j != i)}
    assert {r.doc_id for r in out if r.component_id == 0} - {0} == linked


def test_suffix_dedup_equals_brute_force(frame, corpus, small_shards, docs, empty):
    first, want = {}, {}
    for k, t in enumerate(corpus):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], k) < k:
                gone[i : i + 50] = True
        want[k] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame).collect()}
    assert {k: bytes(r.kept) for k, r in got.items()} == want
    for k, r in got.items():
        raw = bytearray(corpus[k].encode())
        for s in reversed(r.removed_spans):
            del raw[s.start : s.start + s.length]
        assert bytes(raw) == want[k] and r.n_removed == r.n_bytes - len(raw)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_odd_rows_of_the_substring_operators(spark):
    """Null texts, null ids and repeated rows: the values, not only that there is one for each row."""
    long, other = "".join(f"word{k} " for k in range(60)), "".join(f"term{k} " for k in range(70))
    rows = [(7, long, 1), (7, long, 1), (9, long, 1), (None, long, 1), (5, None, 1), (None, None, 1), (8, "", 1), (4, other, 1), (None, other, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").withColumn("count", F.lit(1))
    n, m = len(long.encode()), len(other.encode())
    want = Counter({(7, n, 0): 2, (9, n, n): 1, (None, n, n): 1, (5, 0, 0): 1, (None, 0, 0): 1, (8, 0, 0): 1, (4, m, 0): 1, (None, m, m): 1})
    assert Counter(map(tuple, suffix_dedup.suffix_dedup(df).select("doc_id", "n_bytes", "n_removed").collect())) == want
    got = chunk_dedup.substring_dedup(df)
    assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_removed").collect())) == want
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({(7, long): 2, (9, ""): 1, (None, ""): 2, (5, None): 1, (None, None): 1, (8, ""): 1, (4, other): 1}) 


def test_clashing_columns_and_null_ids(spark, docs):
    wide = docs.withColumns({c: F.lit(1) for c in ("n", "node", "row", "length", "part", "n_bytes", "piece", "root", "token")})
    assert token_counts.token_counts(wide, WORD).count() == packing.pack_documents(wide, WORD, with_ids=False).filter("piece = 0").count() == docs.count()
    assert byte_bpe.encode_decode(wide, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).count() == suffix_dedup.suffix_dedup(wide).count() == docs.count()
    kept = jaccard_join.keep_representatives(wide)
    assert kept.columns == wide.columns and Counter(r.doc_id for r in kept.filter("doc_id >= 100 OR doc_id IS NULL").collect()) == Counter({100: 1, None: 1})
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got[(None, 1)] == got[(101, 1)] == got[(100, 1)] == 100 and got[(None, 0)] is None and got[(0, 0)] == 0


def test_chained_near_copies_are_one_component(spark):
    """Each text differs from the one before in a word or two: neighbours link, distant ones share nothing."""
    rng = random.Random(5)
    w, rows = [f"w{rng.randint(0, 10**6)}" for _ in range(60)], []
    for i in range(400):
        w[rng.randrange(60)] = f"own{i}"
        rows.append((i, " ".join(w)))
    sets, root = [shingle_set(t) for _, t in rows], list(range(400))
    for i in range(400):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))



def test_suffix_dedup_of_hot_keys(frame, small_shards, monkeypatch):
    """Keys dealt out by the digests of their windows give the same bytes."""
    want = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame).collect()}
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame).collect()} == want


def test_suffix_dedup_with_rows_of_a_shard_in_another_order(frame, small_shards, monkeypatch):
    """The two reads of a shard bring its rows in different orders, as remote fetches may."""
    want = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame).collect()}
    repeated = suffix_dedup.repeated_windows

    def shuffled(docs):
        plain, found = repeated(docs)
        return plain.orderBy(F.xxhash64("doc_id", F.lit(5))), found

    monkeypatch.setattr(suffix_dedup, "repeated_windows", shuffled)
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame).collect()} == want


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for k in range(60):
        d = rng.integers(0, 1 + k % 4, int(rng.integers(1, 200))).astype(np.uint8)
        b, order = d.tobytes(), suffixes.suffix_order(d, 50)
        prefix = suffixes.common_prefixes(d, order)
        for i, j in zip(order[1:], order[:-1]):
            n = 0
            while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert prefix[i] == n


def test_chunk_dedup_equals_brute_force(frame, corpus, small_shards, docs, empty):
    first, chunks, want = {}, {}, {}
    for k, t in enumerate(corpus):
        raw = t.encode()
        at = [0, *[int(c) - 16 for c in chunk_dedup.cuts(np.frombuffer(bytes(16) + raw, np.uint8)) if 0 < c - 16 < len(raw)], len(raw)]
        chunks[k] = [(a, b) for a, b in zip(at, at[1:]) if b > a]
        for a, b in chunks[k]:
            first.setdefault(raw[a:b], k)
    for k, t in enumerate(corpus):
        raw, keep, run = t.encode(), b"", []
        for a, b in [*chunks[k], (None, None)]:
            if a is not None and first[raw[a:b]] < k:
                run.append((a, b))
                continue
            if run and run[-1][1] - run[0][0] < chunk_dedup.MIN_RUN:
                keep += raw[run[0][0] : run[-1][1]]
            run = []
            keep += raw[a:b] if a is not None else b""
        want[k] = keep.decode()
    wide = frame.withColumn("bucket", F.lit(3)).withColumn("n_bytes", F.lit("x"))
    got = chunk_dedup.substring_dedup(wide)
    assert {r.doc_id: r.text for r in got.collect()} == want and got.select("bucket").distinct().first()[0] == 3
    assert chunk_dedup.substring_dedup(empty).count() == 0


def test_an_insertion_moves_few_cuts():
    rng = np.random.default_rng(2)
    d = rng.integers(97, 123, 5000).astype(np.uint8)
    a, b = set(chunk_dedup.cuts(d)), {c - 3 for c in chunk_dedup.cuts(np.concatenate((d[:1000], d[:3], d[1000:]))) if c > 1020}
    assert {c for c in a if c > 1020} == b


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels)
    held = out.filter("held_out").join(labels, "doc_id").toPandas()
    pos, neg = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
    assert (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean() > 0.8
    assert (neg >= toxicity.THRESHOLD).mean() < 0.1
    assert all((r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in out.limit(200).collect())
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in out.filter("predicted = 1").limit(30).collect():
        assert all(0 <= s.start and s.start + s.length <= len(text[r.doc_id]) for s in r.offending)


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (2, None), (None, 1), (100, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out) and {r.score for r in out if r.doc_id in (0, 1)} == {0.0}
    assert toxicity.toxicity(empty, labels.filter("false")).count() == 0
    assert toxicity.without_toxic(docs.withColumn("score", F.lit(1)), labels).columns == [*docs.columns, "score"]


def test_toxicity_scores_as_it_learns(spark):
    """Scores, noisy-or and offending sentences by plain loops over distinct slots, the function that training sums."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = [r.text for r in rows.limit(150).collect()] + ["", None, "abcd abcd, ABCD. \nabcde? x", "word " * 250_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    offence = 0
    far = lambda t: t.withColumn("doc_id", F.col("doc_id") + 1000)
    both, labels = df.unionByName(far(rows.select("doc_id", "text"))), far(labels)
    got = {r.doc_id: r for r in toxicity.toxicity(both, labels).filter("doc_id < 1000").collect()}
    own = toxicity.fit(both, labels)
    for i, text in enumerate(texts):
        clean, bad, at = 1.0, [], 0
        for s in toxicity.SENTENCE.findall(text or ""):
            slots = {k for word in s.split() for k in toxicity.features(word)}
            p = 1 / (1 + np.exp(-min(30, max(-30, sum(float(own[0][k]) for k in slots) + own[1]))))
            clean *= 1 - p
            if p >= toxicity.THRESHOLD:
                bad.append((at, len(s)))
            at += len(s)
        assert abs(got[i].score - (1 - clean if text else 0)) < 1e-6 and [(o.start, o.length) for o in got[i].offending] == bad
        offence += len(bad)
    assert offence > 0 and own[1] < 0 and (own[0] >= 0).all()


def test_long_texts_are_learned_from_by_excerpts():
    long = "".join(f"sentence number {i}. " for i in range(9000))
    some = toxicity.excerpt(long, 5000)
    assert 4900 < len(some) <= 5000 and all(s in long for s in toxicity.SENTENCE.findall(some)) and toxicity.excerpt(some, 5000) == some
    assert [int(s.split()[2][:-1]) for s in toxicity.SENTENCE.findall(some) if s.strip()] == sorted(int(s.split()[2][:-1]) for s in toxicity.SENTENCE.findall(some) if s.strip())
    texts = ["this is vile stuff. fine words here. " * 3, "calm words in a row. fine words here. "] * 40
    w, b = toxicity.learn([t + " " * k for k, t in enumerate(texts)], np.array([1, 0] * 40))
    s = toxicity.Weights(w, b)
    assert toxicity.score(texts[0], s)[0] >= toxicity.THRESHOLD > toxicity.score(texts[1], s)[0]


def test_registered_queries_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for n in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SMALL}/{n}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        got = registry.QUERIES[name](spark, SMALL)
        cols = sorted(got.columns)
        want = con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, got.select(*cols).collect())) == Counter(want), name

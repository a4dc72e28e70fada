"""The whole pipeline against a brute-force version, on a small corpus with every kind of copy, and on odd tables."""

import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from tallyloom.llm import chunk_dedup, toxicity
from tallyloom.llm.common import table

WORD = public.path("word_bpe_49k.json")
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, path, documents, labels=()):
    spark.createDataFrame(list(documents), KINDS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def representatives(docs):
    """The smallest id of each component of sets with a similarity of 0.75 or more."""
    ids = sorted(docs)
    sets, root = {i: shingle_set(docs[i]) for i in ids}, {i: i for i in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: docs[i] for i in ids if find(i) == i}


def without_repeats(docs):
    """Runs of chunks that a smaller id holds go if they have MIN_RUN bytes."""
    chunks, first = {}, {}
    for k in sorted(docs):
        raw = (docs[k] or "").encode()
        at = [0, *[int(c) - 16 for c in chunk_dedup.cuts(np.frombuffer(bytes(16) + raw, np.uint8)) if 0 < c - 16 < len(raw)], len(raw)]
        chunks[k] = [raw[a:b] for a, b in zip(at, at[1:]) if b > a]
        for c in chunks[k]:
            first.setdefault(c, k)
    out = {}
    for k, own in chunks.items():
        keep, run = b"", b""
        for c in [*own, None]:
            if c is not None and first[c] < k:
                run += c
                continue
            keep += run if len(run) < chunk_dedup.MIN_RUN else b""
            run = b""
            keep += c or b""
        out[k] = keep.decode("utf-8", "ignore")
    return out


def by_brute_force(spark, sf):
    rows = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    w, bias = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    weights = toxicity.Weights(w, bias)
    clean = {i: t for i, t in rows.items() if toxicity.score(t or "", weights)[0] < toxicity.THRESHOLD}
    least = {}
    for i in sorted(clean):
        least.setdefault(clean[i] or "", i)
    return len(rows) - len(clean), without_repeats(representatives({i: clean[i] for i in least.values()}))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, out, labels = " ".join(words(70)), [], []
    for i in range(150):
        w = words(rng.randint(3, 140))
        if i % 9 == 0:
            w.insert(len(w) // 2, passage)
        if i % 5 == 0:
            w.insert(len(w) // 2, "vilescum wretchdog hatefool.")
        text = " ".join(w)
        if i % 7 == 3 and out:
            text = rng.choice(out)
        if i % 7 == 5 and out:
            text = rng.choice(out) + " tail"
        out.append(text)
        labels.append((i, 1, int("vilescum" in text)))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(out)] + [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "word " * 3000, "en", "s", 15000)]
    return put(spark, tmp_path_factory.mktemp("corpus"), rows, labels)


def test_pipeline_equals_brute_force(spark, corpus):
    toxic, want = by_brute_force(spark, corpus)
    t, room, got, bins = Tokenizer.from_file(WORD), 2048, {}, {}
    assert toxic > 10 and len(want) < 130
    for r in p.run(spark, corpus).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ids = {k: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for k, x in want.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: [(n, a, len(x[a : a + room]), zlib.crc32(x[a : a + room].tobytes())) for n, a in enumerate(range(0, len(x), room))] for k, x in ids.items()}
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= room


def test_each_stage_keeps_the_columns(spark, corpus):
    docs = table(spark, corpus, "documents").withColumns({c: F.lit(1) for c in ("n", "h", "s", "kept", "bucket", "score")})
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns and out.count() > 20, name


def test_pipeline_on_odd_tables(spark, tmp_path):
    assert p.run(spark, put(spark, tmp_path / "empty", [])).count() == 0
    odd = [(1, None, None, None, None), (2, None, None, None, None), (None, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (4, "x" * 5000, "en", "s", 5000)]
    got = {r.doc_id for r in p.run(spark, put(spark, tmp_path / "odd", odd, [(1, None, None), (None, 1, 1)])).collect()}
    assert got == {1, 3, 4}

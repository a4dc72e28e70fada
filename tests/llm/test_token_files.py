"""Framed token files against the library, through sums of a known value, in any order, and damaged."""

import binascii
import glob
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import records, registry, token_files

WORD = public.path("word_bpe_49k.json")
TEXTS = ["", None, "a b c", "x" * 3000, "<|endoftext|> ok", "Ünïcode 日本語", "word " * 300_000, *[f"text number {i} of many" for i in range(60)]]


@pytest.fixture
def docs(spark):
    rows = [((i * 7) % 67, t, "x") for i, t in enumerate(TEXTS)] + [(5, "again", "y"), (5, "again", "y"), (None, "no id", None), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)


def wanted(df):
    t = Tokenizer.from_file(WORD)
    return [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in df.collect()]


def bitwise(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_sums_of_frames():
    rng = random.Random(2)
    some = [b"", b"123456789", *[rng.randbytes(n) for n in (1, 3, 4, 63, 64, 65, 128, 1000, 5000)]]
    assert records.crc32c(some).tolist() == [bitwise(x) for x in some]
    assert records.crc32c([b"123456789"]).tolist() == [0xE3069283] and binascii.crc32(b"123456789") == 0xCBF43926
    assert records.crc32c([]).tolist() == []
    data = b"".join(records.frames(some))
    found = records.walk(data)
    assert records.unframe(data, [a for a, _ in found], [n for _, n in found], "f") == some
    for at in (0, 9, 17, len(data) - 1):
        bad = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises(ValueError):
            records.unframe(bad, [a for a, _ in found], [n for _, n in found], "f")
    with pytest.raises(ValueError):
        records.walk(data[:-1])


def test_files_hold_every_document_in_order(docs, tmp_path):
    index = token_files.write_token_files(docs, WORD, str(tmp_path / "t"), 2, shards=4)
    got = sorted(token_files.read_records(index, str(tmp_path / "t")).collect(), key=lambda r: (r.shard, r.record))
    ids = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got]
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert [x[0] for x in ids] == [x[0] for x in sorted(wanted(docs), key=key)]
    assert sorted(ids, key=lambda x: (key(x), x[1])) == sorted(wanted(docs), key=lambda x: (key(x), x[1]))
    base = {r.shard: r.base for r in token_files.shard_starts(index).collect()}
    before = 0
    for r in got:
        assert base[r.shard] + r.before == before
        before += r.n_tokens
    one = token_files.read_shuffled(index, str(tmp_path / "t"), 1, 3)
    a, b = [[(r.shard, r.record) for r in token_files.read_shuffled(index, str(tmp_path / "t"), s, 3).collect()] for s in (1, 2)]
    assert sorted(a) == sorted(b) == [(r.shard, r.record) for r in got] and a != b and a == [(r.shard, r.record) for r in one.collect()]


def test_attempts_that_do_not_count_are_not_read(docs, tmp_path):
    index = token_files.write_token_files(docs, WORD, str(tmp_path / "t"), 2, shards=2)
    (tmp_path / "t" / "data-000000-999999.rec").write_bytes(b"half a record")
    assert token_files.read_records(index, str(tmp_path / "t")).count() == docs.count()


def test_damage_ends_the_read(docs, tmp_path):
    index = token_files.write_token_files(docs, WORD, str(tmp_path / "t"), 2, shards=1)
    (file,) = glob.glob(str(tmp_path / "t" / "data-*.rec"))
    data = bytearray(open(file, "rb").read())
    data[len(data) // 2] ^= 4
    open(file, "wb").write(data)
    with pytest.raises(Exception, match="damaged record"):
        token_files.read_records(index, str(tmp_path / "t")).collect()


def test_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op12_token_files"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in wanted(docs))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    docs.filter("false").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert registry.QUERIES["op12_token_files"](spark, str(tmp_path)).count() == 0

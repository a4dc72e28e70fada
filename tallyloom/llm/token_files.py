"""Token ids in binary files (12): framed records in order of documents, and an index of offsets for reads in any order."""

from __future__ import annotations

import struct
import uuid
import zlib
from contextlib import ExitStack

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_dir
from . import word_bpe
from .common import doc_rows, release, slices, spread, table
from .records import frames, unframe

#: Characters encoded and bytes of a file read at a time; files that a task holds open.
SLICE, SPAN, OPEN = 2_000_000, 8_000_000, 64
#: Shards whose totals are summed in one group.
SHARDS = 4096
#: Payload: doc_id, 1 if there is no doc_id, bytes of an id; then the ids. All little-endian.
HEAD, HEAD_SIZE = "<qII", struct.calcsize("<qII")
INDEX = "shard int, record int, file string, offset long, length long, doc_id long, n_tokens long, before long"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Write every whole text as ids and `end_id` into files of `folder`; returns the index, itself written to folder/index.

    Index: one row for each row of docs with its shard, record (from 0 in the shard), file, offset and length of its frame
    in that file, doc_id, n_tokens, and before, the ids of the shard before it. Records are in ascending doc_id, rows without
    an id first; rows that repeat an id keep their order of reading. A null or empty text is end_id alone. No documents, no
    files. Other columns are not read. Ids take 2 bytes where the vocabulary allows.

    Texts are sorted by range of (doc_id, row), so that even one id of all rows is dealt out, and a task writes one file. A
    task's file has its attempt in the name, and the index, which Spark commits, names the files that count: what a lost or
    doubled attempt has written is never read.
    """
    spark = docs.sparkSession
    bpe = word_bpe.load(tokenizer)
    width = 2 if max(*bpe.vocab.values(), *bpe.special.values(), end_id) < 1 << 16 else 4
    end = np.array([end_id], "<u4").tobytes()
    root, path = store(folder)
    root.create_dir(path, recursive=True)

    def payload(doc: int | None, ids: bytes) -> bytes:
        body = np.frombuffer(ids + end, "<u4").astype(f"<u{width}").tobytes()
        return struct.pack(HEAD, doc or 0, doc is None, width) + body

    def run(batches):
        task, ids = TaskContext.get(), word_bpe.ids(tokenizer)
        shard = task.partitionId()
        name = f"data-{shard:06d}-{task.taskAttemptId()}.rec"
        offset = record = before = 0
        with ExitStack() as held:
            out = None
            for b in batches:
                for start, texts in slices(b.column("text"), SLICE):
                    if out is None:
                        where, at = store(folder)
                        out = held.enter_context(where.open_output_stream(f"{at}/{name}"))
                    own = b.column("doc_id")[start : start + len(texts)].to_pylist()
                    payloads = [payload(d, x) for d, x in zip(own, ids.encode(texts), strict=True)]
                    found = frames(payloads)
                    out.write(b"".join(found))
                    length = np.array([len(x) for x in found], np.int64)
                    n = np.array([(len(p) - HEAD_SIZE) // width for p in payloads], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(n), shard, np.int32)),
                            pa.array(record + np.arange(len(n), dtype=np.int32), pa.int32()),
                            pa.array([name] * len(n), pa.string()),
                            pa.array(offset + np.cumsum(length) - length),
                            pa.array(length),
                            pa.array(own, pa.int64()),
                            pa.array(n),
                            pa.array(before + np.cumsum(n) - n),
                        ],
                        ["shard", "record", "file", "offset", "length", "doc_id", "n_tokens", "before"],
                    )
                    record, offset, before = record + len(n), offset + int(length.sum()), before + int(n.sum())

    rows = doc_rows(docs).withColumn("row", F.monotonically_increasing_id())
    shards = shards or max(spark.sparkContext.defaultParallelism, 2 * rows.rdd.getNumPartitions())
    order = ["doc_id", "row"]
    index = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(run, INDEX)
    index.write.parquet(f"{folder}/index")
    release(spark)
    return read_index(spark, folder)


def read_index(spark, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """shard, record, before, doc_id, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit) of the rows of an index, in their order.

    Frames that lie side by side are read at once, SPAN bytes at most or one record. Both checksums of every frame are
    compared, and doc_id and n_tokens with the index; a record that differs ends the job with its file and place.
    """

    def run(batches):
        where, at = store(folder)
        opened: dict[str, pa.NativeFile] = {}

        def read(file: str, offset: int, n: int) -> bytes:
            if file not in opened:
                while len(opened) >= OPEN:
                    opened.pop(next(iter(opened))).close()
                opened[file] = where.open_input_file(f"{at}/{file}")
            opened[file].seek(offset)
            return opened[file].read(n)

        for b in batches:
            file, offset, length = b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()
            i = 0
            while i < len(file):
                j, n = i + 1, length[i]
                while j < len(file) and file[j] == file[i] and offset[j] == offset[i] + n and n + length[j] <= SPAN:
                    n += length[j]
                    j += 1
                rows = b.slice(i, j - i)
                got = unframe(read(file[i], offset[i], n), [o - offset[i] for o in offset[i:j]], length[i:j], file[i])
                heads = [struct.unpack_from(HEAD, p) for p in got]
                ids = [np.frombuffer(p, f"<u{w}", offset=HEAD_SIZE).astype("<u4") for p, (_, _, w) in zip(got, heads, strict=True)]
                docs, n_tokens = [None if none else d for d, none, _ in heads], [len(x) for x in ids]
                if docs != rows.column("doc_id").to_pylist() or n_tokens != rows.column("n_tokens").to_pylist():
                    raise ValueError(f"the index and {file[i]} differ at {offset[i]}")
                kept = [rows.column(c) for c in ("shard", "record", "before")]
                out = [*kept, *(pa.array(x, pa.int64()) for x in (docs, n_tokens, [zlib.crc32(x) for x in ids])), *[pa.array([x.tobytes() for x in ids], pa.binary())] * with_ids]
                yield pa.RecordBatch.from_arrays(out, names)
                i = j
        for f in opened.values():
            f.close()

    kinds = {"shard": "int", "record": "int", "before": "long", "doc_id": "long", "n_tokens": "long", "ids_crc32": "long"} | ({"ids": "binary"} if with_ids else {})
    names = list(kinds)
    return index.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def read_shuffled(index: DataFrame, folder: str, seed: int, parts: int) -> DataFrame:
    """The records in an order drawn from the seed, in `parts` partitions of that order: only index rows are exchanged, records are read at their offsets."""
    drawn = index.withColumn("key", F.xxhash64(F.lit(seed), "shard", "record"))
    return read_records(drawn.repartitionByRange(parts, "key", "shard", "record").sortWithinPartitions("key", "shard", "record").drop("key"), folder)


def shard_starts(index: DataFrame) -> DataFrame:
    """shard, base: ids of all shards before it. Totals are summed inside groups of SHARDS shards and then over groups."""
    total = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("shard") / SHARDS))
    below = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = total.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(below.orderBy("block")), F.lit(0)).alias("of_block"))
    inside = F.coalesce(F.sum("n").over(below.partitionBy("block").orderBy("shard")), F.lit(0))
    return total.withColumn("inside", inside).join(blocks, "block").select("shard", (F.col("of_block") + F.col("inside")).alias("base"))


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    index = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    found = read_records(spread(spark, index), folder, with_ids=False)
    return found.join(shard_starts(index), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

"""Reading landed files: declared schemas, tolerant and strict JSON, logs, file trees, images. Survey ids stand in brackets."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import header_field


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[SRC01, SRC02] CSV with a header; ids with leading zeros stay strings because the schema says so."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """[SRC06] One object a line. Bad lines are dropped, or fail when strict; an absent key is null, not a default."""
    return spark.read.json(path, schema=schema, mode="FAILFAST" if strict else "DROPMALFORMED")


def json_document(spark: SparkSession, path: str, schema: str, default: bool = False) -> DataFrame:
    """[SRC03, SRC04, SRC05, SRC32] One nested object a file; unreadable files fail, or give null fields with default."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="PERMISSIVE" if default else "FAILFAST")


def revision_files(spark: SparkSession, root: str) -> DataFrame:
    """[SRC07, SRC08, SRC28] group, ordinal, sha8, content of <group>/rev_<n>_<hex>.<ext> where group is digits."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path"), F.col("content"))
    at = lambda k: F.regexp_extract("path", r"/([0-9]+)/rev_(\d+)_([0-9a-f]+)\.\w+$", k)
    return raw.filter(at(1) != "").select(at(1).alias("group"), at(2).cast("int").alias("ordinal"), at(3).alias("sha8"), "content")


def targets(paths: DataFrame) -> DataFrame:
    """[SRC07, SRC08, SRC28] group, kind (base, mutation, revision), ordinal and sha8 of files in groups named by digits; other files go."""
    at = lambda k: F.regexp_extract("path", r"/([0-9]+)/(?:(base)|(mutation)_\w+|(rev)_(\d+)_([0-9a-f]+))\.\w+$", k)
    kind = F.when(at(2) != "", "base").when(at(3) != "", "mutation").when(at(4) != "", "revision")
    return paths.select(at(1).alias("group"), kind.alias("kind"), F.nullif(at(5), F.lit("")).try_cast("int").alias("ordinal"), F.nullif(at(6), F.lit("")).alias("sha8")).filter("kind IS NOT NULL")


def capture_headers(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """[SRC09, SRC10] The first line of each log as typed fields; absent or unreadable ones are null, order does not matter."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    line = F.split("value", "\n")[0]
    return text.select("file", *[header_field(line, n).try_cast(t).alias(n) for n, t in fields.items()])


def readings(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """[SRC11, SRC12] file, idx, us of every reading in a log; zero spans are dropped before the index is given."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    found = text.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("pos", "us")).select("file", "pos", F.col("us").cast("long").alias("us")).filter("us > 0")
    return found.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1).alias("idx"), "us")


def commit_log(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """[SRC22] commit, committed_at, author, subject, files from NUL-separated blocks: a tab-separated head line, then names."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\x00")).alias("b")).filter("trim(b) <> ''")
    lines = blocks.select(F.split(F.trim("b"), "\n").alias("l"))
    head = F.split(F.col("l")[0], "\t", 4)
    names = F.filter(F.slice("l", 2, F.size("l")), lambda x: F.endswith(x, F.lit(suffix)))
    return lines.select(head[0].alias("commit"), head[1].try_cast("long").alias("committed_at"), head[2].alias("author"), F.substring(head[3], 1, 200).alias("subject"), names.alias("files"))


def id_list(spark: SparkSession, path: str, width: int) -> DataFrame:
    """[SRC19, SRC20, SRC21] id, reason from lines `id[,id] [# reason]`; comments and blanks go, ids are padded with zeros."""
    t = spark.read.text(path).select(F.trim(F.regexp_extract("value", r"^([^#]*)", 1)).alias("ids"), F.nullif(F.trim(F.regexp_extract("value", r"#(.*)$", 1)), F.lit("")).alias("reason")).filter("ids <> ''")
    return t.select(F.explode(F.split("ids", r"[,\s]+")).alias("id"), "reason").select(F.lpad("id", width, "0").alias("id"), "reason")


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[SRC15, SRC17] Entries of append-only logs. A torn last line is dropped; a bad line before it voids its file."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    rows = text.select("file", F.size(lines).alias("n"), F.posexplode(lines).alias("ix", "line"))
    parsed = rows.withColumns({"e": F.from_json("line", schema), "ok": F.try_parse_json("line").isNotNull()})
    void = parsed.filter("NOT ok AND ix < n - 1").select("file").distinct()
    return parsed.filter("ok").join(void, "file", "left_anti").select("file", "ix", "e.*")


def image_bands(images: DataFrame, top: float, bottom: float) -> DataFrame:
    """[SRC25, AGG30] path, rgb, n: colours of the rows between two shares of the height of 8-bit RGB or RGBA PNG files; other kinds fail."""

    def run(batches):
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                pixels = decode_png(bytes(raw))
                part = pixels[int(len(pixels) * top) : int(len(pixels) * bottom)].reshape(-1, 3).astype(np.int64)
                rgb, n = np.unique(part[:, 0] << 16 | part[:, 1] << 8 | part[:, 2], return_counts=True)
                yield pd.DataFrame({"path": path, "rgb": rgb, "n": n})

    return images.select("path", "content").mapInPandas(run, "path string, rgb long, n long")


def decode_png(raw: bytes) -> np.ndarray:
    """Pixels of an 8-bit, not interlaced RGB or RGBA image, as the PNG specification describes chunks and filters."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ValueError("only 8-bit RGB or RGBA without interlace is read")
    width, height, step = head[0], head[1], 3 if head[3] == 2 else 4
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.int64)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros(width * step, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(width * step):
                left, corner = (out[y, x - step], up[x - step]) if x >= step else (0, 0)
                if kind == 1:
                    add = left
                elif kind == 3:
                    add = (left + up[x]) >> 1
                else:
                    p = left + up[x] - corner
                    add = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                out[y, x] = (line[x] + add) & 255
    return out.reshape(height, width, step)[:, :, :3].astype(np.uint8)

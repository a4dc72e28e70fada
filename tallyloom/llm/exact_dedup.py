"""Exact dedup (9), native: 128-bit content hash, byte comparison inside groups, the largest or smallest id stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, table

SALTS = 64


def exact_groups(docs: DataFrame, keep: str = "min") -> DataFrame:
    """Group identical texts: doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    A null text is the empty text. Rows that repeat an id and its text each count and carry the same answer. A row
    without an id stays only where no row of its group has one. An empty table gives an empty result.

    The text itself is the second key below the hash, so Spark compares bytes and a collision of hashes stays apart.
    Copies fold before the exchange, so a hot group sends one row for each task. The answers return to the rows by
    (hash, salt) and only for salts that occur, which deals a group of a third of all rows to SALTS tasks.
    """
    rows = doc_rows(docs).withColumn("h", F.unhex(F.md5("text"))).withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    texts = rows.groupBy("h", "text").agg(best.alias("keep_id"), F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, s)")).alias("salts"))
    sure = F.when(F.count("*") == 1, F.first("n")).otherwise(F.raise_error(F.lit("two texts share both digests")))
    classes = (
        texts.select("h", F.sha2("text", 256).alias("sha"), "keep_id", "n", "salts")
        .groupBy("h", "sha")
        .agg(F.first("keep_id").alias("keep_id"), sure.cast("long").alias("group_size"), F.first("salts").alias("salts"))
        .select("h", "sha", "keep_id", "group_size", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)).alias("s"))
    )
    keys = rows.select("doc_id", "h", F.sha2("text", 256).alias("sha"), "s")
    return keys.join(classes, ["h", "sha", "s"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of docs, with all their columns, that stay; of rows that repeat an id and its text one stays."""
    best = exact_groups(docs, keep).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    rows = docs.withColumn("__of", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    kept = rows.join(best, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__sha")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__of"]).drop("__of")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

"""Shared helpers: reading tables, sizing partitions, the shared folder for lineage cuts."""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


#: What a Python worker keeps from task to task; operators without use for it give it back.
KEPT: list = []


def fresh() -> None:
    """Forget what tokenizers have remembered in this worker: a worker serves one operator after another, and memories would add up."""
    full = [c for c in KEPT if c.cache_info().currsize]
    for c in full:
        c.cache_clear()
    if full:
        gc.collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_rows(docs: DataFrame) -> DataFrame:
    """doc_id BIGINT and text STRING; a null text is the empty text. Other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def slices(column: pa.Array, most: int):
    """Start and texts of runs of at most `most` characters, one text at least."""
    texts, start, size = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py()
        if texts and size + len(t) > most:
            yield start, texts
            texts, start, size = [], i, 0
        texts.append(t)
        size += len(t)
    if texts:
        yield start, texts


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts, one aggregate over the text column."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def parts(total: int, each: int, least: int = 1) -> int:
    """How many partitions of about `each` bytes hold `total`."""
    return max(least, -(-total // each))


def spread(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """At least one partition for each core: small inputs come as one file, which one task would read."""
    n = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Written tables that nothing reads any more give their disk back: an empty frame overwrites each."""
    for df in tables:
        if files := df.inputFiles():
            df.sparkSession.range(0).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go now, not when the driver next happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

"""Writing results. Survey ids stand in brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import upsert, work_list


def csv(df: DataFrame, path: str) -> None:
    """[SNK01] CSV with a header; nulls and NaN are empty cells."""
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.write.csv(path, header=True, nullValue="", emptyValue="", mode="overwrite")


def by_partition(df: DataFrame, path: str, parts: list[str]) -> None:
    """[SNK02, SNK13, INC21] Parquet by partition; only partitions that df has are replaced. One shuffle by the parts, so few files."""
    df.repartition(*parts).write.partitionBy(*parts).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """[SNK03, SNK04, SNK16] Append the rows whose key the table does not have."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    try:
        fresh = work_list(fresh, spark.read.parquet(path), keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)


def upsert_table(df: DataFrame, old: DataFrame, path: str, keys: list[str], newest: list[Column]) -> DataFrame:
    """[SNK05] The merged table at a new path; the caller swaps the name, single writer."""
    upsert(old, df, keys, newest).write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def changed_only(df: DataFrame, target: DataFrame, key: str, digest: str) -> DataFrame:
    """[SNK08] Rows whose digest the target does not have under their key."""
    return df.join(target.select(key, F.col(digest).alias("d_")), key, "left").filter(~F.col(digest).eqNullSafe(F.col("d_"))).drop("d_")


def retarget(df: DataFrame, columns: list[str], source: str, dest: str) -> DataFrame:
    """[SNK06, SNK07] Path columns with one prefix replaced."""
    return df.withColumns({c: F.when(F.startswith(c, F.lit(source)), F.concat(F.lit(dest), F.substring(F.col(c), F.lit(len(source) + 1), F.length(c)))).otherwise(F.col(c)) for c in columns})


def report(df: DataFrame, key: str, measures: list[str], most: int = 1000) -> str:
    """[SNK11, SNK12] A Markdown table of an aggregated frame, ordered by key; an error where it has more than `most` rows, never a part of it."""
    rows = df.select(key, *measures).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line([key, *measures]), line(["---"] * (1 + len(measures))), *[line(r) for r in rows]])


def manifest(df: DataFrame, **settings: str) -> DataFrame:
    """[SNK14, INC08] One row: settings, rows, and an order-free digest of the content."""
    rows = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("rows"), F.bit_xor("h").alias("digest"))
    return rows.select(*[F.lit(v).alias(k) for k, v in settings.items()], "rows", "digest")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """[1.4 vacuity] df, or an error where it is empty: a check with no input must not pass."""
    if not df.head(1):
        raise ValueError(f"no rows: {what}")
    return df


def require_none(df: DataFrame, what: str) -> None:
    """[RUL07, INC24, MLE03] An error with an example where df has a row."""
    if bad := df.head(1):
        raise ValueError(f"{what}: {bad[0]}")

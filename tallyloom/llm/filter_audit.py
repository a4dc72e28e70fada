"""Filter interaction audit (11): masks unpivoted against the steps of every order of the filters."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Orders grow with the factorial of the filters: 5,040 for seven.
MOST = 7
WORDS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Maximal runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(text, WORDS), lambda w: w != "")


def text_failures() -> dict[str, Column]:
    """Failure conditions A to D over columns text and words."""
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    length = F.length("text").cast("long")
    capitals = length - F.length(F.translate("text", CAPITALS, ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * length, "D": F.col("text").rlike("[#$%&*|]")}


def failures(docs: DataFrame, text_filters: Mapping[str, Column], copies: str) -> DataFrame:
    """doc_id, part (the source), mask, n: how many rows share them. Bit k of mask is set where a row fails filter k.

    The filters are text_filters in their order and then `copies`, which fails where the text equals that of any row with a
    smaller doc_id, table-wide. A null text or source is the empty string. A row without doc_id never fails `copies` and makes
    no other row fail it; rows that repeat an id each count and are no copies of each other. Other columns are not read.

    Texts are read once, as digests. Equal digests fold in the task that reads them, and the smallest id of each text
    returns by (id, digest), so neither copies of a text nor rows of a source meet in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_filters.values())), F.lit(0))
    digests = rows.withColumn("words", words(F.col("text"))).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask.alias("mask"))
    cells = cut(digests.groupBy("doc_id", "sha", "part", "mask").agg(F.count("*").alias("n")))
    first = cells.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    fails = F.col("doc_id").isNotNull() & F.col("first").isNull()
    last = 1 << len(text_filters)
    return cells.join(first, ["doc_id", "sha"], "left").select("doc_id", "part", (F.col("mask") + F.when(fails, last).otherwise(0)).alias("mask"), "n")


def label_flags(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic: 1 where any row of the document says so. Rows without an id label nothing."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))


def audit(cells: DataFrame, filters: str) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    cells: part, mask (bit k for letter k of `filters`), n, good, toxic; one row for each part and mask. Every part gets a row
    for each step of each of the orders, zeros included; no cells, no rows.

    Long form: each cell meets each (order, step); a running bit-or of the failed bits along an order tells what failed before.
    An order's metrics are conditional sums over cells; shapley is the total of `removed` over a filter's window. A part has at
    most 2^k cells, so one exchange by part holds all of it, whatever the number of documents.
    """
    if len(set(filters)) != len(filters) or len(filters) > MOST:
        raise ValueError(f"filters are distinct letters, {MOST} at most")
    bit = {c: 1 << k for k, c in enumerate(filters)}
    steps = F.array(*(F.struct(F.lit("".join(o)).alias("filter_order"), F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(c).alias("filter"), F.lit(bit[c]).alias("bit")) for k, c in enumerate(o))).alias("steps")) for o in permutations(filters)))
    long = cells.repartition("part").withColumn("o", F.explode(steps)).select("part", "mask", "n", "good", "toxic", "o.filter_order", F.explode("o.steps").alias("s")).select("*", "s.*").drop("s")
    long = long.withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("before", F.coalesce(F.bit_or("failed").over(earlier), F.lit(0)))
    fails, clean = F.col("failed") != 0, F.col("before") == 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0))
    metrics = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(clean & ~fails).alias("kept"),
        total(clean & fails).alias("removed"),
        total(~clean & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(clean & fails, "good").alias("good_lost"),
        total(clean & fails, "toxic").alias("toxic_lost"),
    )
    return metrics.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def filter_interactions(docs: DataFrame, labels: DataFrame, text_filters: Mapping[str, Column], copies: str) -> DataFrame:
    """The audit of text_filters and `copies` over all documents, with documents labelled good or toxic; a label without a document counts nowhere."""
    rows = failures(docs, text_filters, copies).join(label_flags(labels), "doc_id", "left")
    lost = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good"), lost("toxic"))
    return audit(cells, "".join(text_filters) + copies)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    out = filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), text_failures(), "E")
    return out.drop("filter")


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), f AS (
  SELECT d.doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INT)) AS good, max(CAST(coalesce(toxic, 0) = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1) l ON l.doc_id = d.doc_id
), cells AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), orders AS (
  SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5
), steps AS (
  SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS earlier FROM orders, range(1, 6) r(k)
), m AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM m
"""

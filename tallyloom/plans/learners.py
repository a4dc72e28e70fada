"""Learners on documents: nested validation, both readings of pairs, hand rules, permutation importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learners, resample, stats
from ..sources.tables import read
from .registry import query

SEED, DESIGN = 20260803, learners.Design(5, 3)
R = lambda c, n=6: F.round(c, n)


def _labelled(spark, sf):
    """Labelled documents with features of their whole texts; the stored fold goes by the source's number."""
    text = F.coalesce("text", F.lit(""))
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    d = read(spark, sf, "documents").select(
        "doc_id",
        "source",
        F.pmod(F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long"), F.crc32(F.col("source").cast("binary"))), F.lit(5)).alias("fold"),
        F.length(text).alias("n_chars"),
        count(",").alias("commas"),
        count("\n").alias("lines"),
        count("!").alias("bangs"),
        count(".").alias("stops"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("capitals"),
    )
    return d.join(read(spark, sf, "labels").select("doc_id", "toxic", "quality"), "doc_id")


FEATURES = ["n_chars", "commas", "lines", "bangs", "stops", "capitals"]


def _fits(rows, s):
    """Each learner's models over its grid, for every set at once."""
    yield "logistic", learners.fit_logistic(rows, DESIGN, s, [0.03, 0.3, 3.0, 30.0])
    yield "kernel", learners.fit_kernel(rows, DESIGN, s, [0.3, 1.0, 3.0, 10.0], ["scale", 0.03], 64, SEED)
    yield "forest", learners.fit_forest(rows, DESIGN, s, 300, [2, 4], [2, 8], SEED)


@query("MLE01 MLE02")
def nested_scores(spark, sf):
    """Three learners through five outer and three inner folds of sources: out-of-fold metrics of each fold."""
    rows = learners.prepared(_labelled(spark, sf), "doc_id", "source", "quality", "fold", [F.log1p(c) for c in FEATURES], DESIGN, SEED)
    s, out = learners.scales(rows, DESIGN), None
    for name, fitted in _fits(rows, s):
        one = learners.nested_cv(rows, DESIGN, fitted).withColumn("learner", F.lit(name))
        out = one if out is None else out.unionByName(one)
    m = stats.ranking_metrics(out, ["learner", "fold"], "score", "y")
    return m.select("learner", "fold", "n", F.col("positives").cast("long").alias("positives"), R(F.col("auc"), 4).alias("auc"), R(F.col("average_precision"), 4).alias("average_precision"))


@query("MLE03", """
WITH g AS (SELECT sha256(coalesce(text, '')) AS text, count(DISTINCT doc_id % 5) AS folds FROM documents GROUP BY 1)
SELECT folds, count(*) AS texts FROM g WHERE folds > 1 GROUP BY 1""")
def straddling_texts(spark, sf):
    """Folds drawn by document let copies of a text straddle them: how many texts lie in how many folds."""
    d = read(spark, sf, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"), (F.col("doc_id") % 5).alias("fold"))
    return learners.straddling(d, "text", "fold").groupBy("folds").agg(F.count("*").alias("texts"))


def _pairs(spark, sf):
    """A labelled document and the next, where their quality differs: right minus left, and whether the right one is the better."""
    d = _labelled(spark, sf).drop("source", "fold", "toxic")
    left = _labelled(spark, sf).select("doc_id", "source", "fold", *(F.col(f).alias(f"l_{f}") for f in FEATURES), F.col("quality").alias("l_quality"))
    p = left.join(d.withColumn("doc_id", F.col("doc_id") - 1), "doc_id").filter(F.col("quality") != F.col("l_quality"))
    return p.select("doc_id", "source", "fold", (F.col("quality") > F.col("l_quality")).cast("int").alias("y"), *((F.col(f) - F.col(f"l_{f}")).cast("double").alias(f) for f in FEATURES))


@query("MLE15 MLE16 MLE19")
def antisymmetric_agreement(spark, sf):
    """Three learners trained on both readings of each pair: how often the sign of f(D) - f(-D), out of fold, agrees with the label, in either reading."""
    both = learners.both_ways(_pairs(spark, sf), "doc_id", FEATURES, "y")
    rows = learners.prepared(both, "reading", "source", "y", "fold", [F.signum(F.col(f)) * F.log1p(F.abs(f)) for f in FEATURES], DESIGN, SEED)
    s, out = learners.scales(rows, DESIGN), None
    keys = both.select("doc_id", "way", F.col("reading").alias("id"))
    for name, fitted in _fits(rows, s):
        scored = learners.nested_cv(rows, DESIGN, fitted).join(keys, "id")
        given = learners.antisymmetric(scored, "doc_id").withColumn("way", F.lit("given"))
        turned = learners.antisymmetric(scored.withColumn("way", -F.col("way")), "doc_id").withColumn("way", F.lit("turned"))
        one = given.unionByName(turned).withColumn("learner", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("learner", "way").agg(F.count("*").alias("pairs"), F.count_if("agrees").alias("agrees"), F.count_if(F.col("s") == 0).alias("zero"))


_COUNT = lambda c: f"length(text) - length(replace(text, {c}, ''))"
_RULES_SQL = f"""
WITH f AS (SELECT doc_id, quality, length(text) AS n_chars, {_COUNT("','")} AS commas, {_COUNT("chr(10)")} AS lines, {_COUNT("'!'")} AS bangs, {_COUNT("'.'")} AS stops FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) JOIN labels USING (doc_id)),
p AS (SELECT CAST(b.quality > a.quality AS INT) AS y, {", ".join(f"b.{f} - a.{f} AS {f}" for f in FEATURES[:5])} FROM f a JOIN f b ON b.doc_id = a.doc_id + 1 WHERE a.quality <> b.quality),
t AS (SELECT {", ".join(f"CASE WHEN count(*) FILTER (({f} > 0) = (y = 1)) >= count(*) FILTER (({f} < 0) = (y = 1)) THEN 1 ELSE -1 END AS t_{f}" for f in FEATURES[:5])} FROM p),
r AS (SELECT y, {", ".join(f"{f} * t_{f} AS {f}" for f in FEATURES[:5])} FROM p, t UNION ALL SELECT 1 - y, {", ".join(f"-{f} * t_{f}" for f in FEATURES[:5])} FROM p, t),
v AS (SELECT y, unnest([{", ".join(f"'sign_{f}'" for f in FEATURES[:5])}, 'lex2', 'vote2', 'lex3', 'vote3']) AS rule, unnest([{", ".join(f"{f} > 0" for f in FEATURES[:5])},
  coalesce(nullif(sign(n_chars), 0), sign(commas)) > 0, sign(n_chars) + sign(commas) > 0, coalesce(nullif(sign(n_chars), 0), nullif(sign(commas), 0), sign(lines)) > 0, sign(n_chars) + sign(commas) + sign(lines) > 0]) AS says FROM r)
SELECT rule, count(*) AS readings, count(*) FILTER (says = (y = 1)) AS right, count(*) FILTER (says) AS says_one FROM v GROUP BY 1"""


@query("MLE17 MLE18", _RULES_SQL)
def hand_rule_scores(spark, sf):
    """Signs, tie-breaks and votes in the direction that the pairs themselves give, over both readings of every pair."""
    features = FEATURES[:5]
    p = _pairs(spark, sf).select("doc_id", "y", *features)
    rules = learners.hand_rules(features, learners.directions(p, features, "y"))
    both = learners.both_ways(p, "doc_id", features, "y")
    long = both.select("y", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), c.alias("says")) for n, c in rules.items()))).alias("r")).select("y", "r.*")
    return long.groupBy("rule").agg(F.count("*").alias("readings"), F.count_if(F.col("says") == (F.col("y") == 1)).alias("right"), F.count_if("says").alias("says_one"))


@query("MLE18 MLE29")
def shallow_trees(spark, sf):
    """Trees of depth 2 and 3 over the pairs, out of fold and over both readings."""
    p = _pairs(spark, sf)
    both = learners.both_ways(p, "doc_id", FEATURES, "y")
    given = learners.prepared(p, "doc_id", "source", "y", "fold", [F.col(f) for f in FEATURES], DESIGN, SEED)
    rows = learners.prepared(both, "reading", "source", "y", "fold", [F.col(f) for f in FEATURES], DESIGN, SEED)
    done, out = learners.grow(given, DESIGN, learners.scales(given, DESIGN), 1, 3, [1], SEED, sampled=False), None
    for depth in (2, 3):
        fitted = learners.Fitted(1, lambda t, c, x, depth=depth: done[t].score(x, depth))
        one = learners.nested_cv(rows, DESIGN, fitted).withColumn("depth", F.lit(depth))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("depth").agg(F.count("*").alias("readings"), F.count_if((F.col("score") > 0.5) == (F.col("y") == 1)).alias("right"))


@query("MLE14 MLE27 SRT08")
def permutation_importance(spark, sf):
    """What each feature is worth to the forest on rows it was not fitted on: ten deals of every fold, features by importance."""
    rows = learners.prepared(_labelled(spark, sf), "doc_id", "source", "quality", "fold", [F.log1p(c) for c in FEATURES], DESIGN, SEED)
    fitted = learners.fit_forest(rows, DESIGN, learners.scales(rows, DESIGN), 100, [4], [2], SEED)
    drop = learners.permutation_drop(rows, DESIGN, fitted, dict.fromkeys(range(DESIGN.outer), 0), 10, SEED)
    return drop.select(F.array(*(F.lit(f) for f in FEATURES))[F.col("feature")].alias("feature"), R(F.col("drop")).alias("drop")).orderBy(F.desc("drop"), "feature")


@query("MLE24 SCA12")
def agreement_by_bin(spark, sf):
    """How often the rise of one feature agrees with the label, by bins of another's change and near its threshold against elsewhere, with exact intervals."""
    p = _pairs(spark, sf).select(F.abs("n_chars").alias("d"), ((F.col("commas") > 0) == (F.col("y") == 1)).cast("long").alias("hit"))
    bins = F.array(F.concat(F.lit("bin "), F.least(F.floor(F.col("d") / 500), F.lit(9)).cast("string")), F.when(F.abs(F.col("d") - 1000) < 500, "near").otherwise("elsewhere"))
    sums = p.select(F.explode(bins).alias("bin"), "hit").groupBy("bin").agg(F.sum("hit").alias("hits"), F.count("*").alias("total"))
    out = resample.exact_intervals(sums, "bin", "hits", "total")
    return out.select("bin", "hits", "total", *(R(F.col(c)).alias(c) for c in ("p_value", "low", "high")))

"""Evaluation queries: ranking metrics, agreement, resampling, learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, resample, stats
from ..sources.tables import read
from .registry import query

R = lambda c, n=6: F.round(c, n)
_SCORED = "s AS (SELECT d.doc_id, d.lang, d.source, d.n_chars AS score, l.toxic AS y, l.quality AS z FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("score"))
    return d.join(read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"), F.col("quality").alias("z")), "doc_id")


@query("MLE04 WIN20", f"""
WITH {_SCORED}, p AS (SELECT a.lang, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM s a JOIN s b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY 1)
SELECT lang, round(auc, 6) AS auc FROM p""")
def roc_auc_by_group(spark, sf):
    return stats.ranking_metrics(_scored(spark, sf), ["lang"], "score", "y").select("lang", R(F.col("auc")).alias("auc")).filter("auc IS NOT NULL")


@query("MLE05", f"""
WITH {_SCORED}, t AS (SELECT lang, score, sum(y) AS p, count(*) AS m FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS n, sum(p) OVER (PARTITION BY lang) AS pos FROM t WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, round(sum(p * tp::DOUBLE / n) / max(pos), 6) AS average_precision FROM c GROUP BY 1 HAVING max(pos) > 0""")
def average_precision(spark, sf):
    return stats.ranking_metrics(_scored(spark, sf), ["lang"], "score", "y").filter("positives > 0").select("lang", R(F.col("average_precision")).alias("average_precision"))


@query("MLE06", f"""
WITH {_SCORED}, c AS (SELECT lang, count(*) FILTER (score > 2000 AND y = 1) AS tp, count(*) FILTER (score > 2000 AND y = 0) AS fp, count(*) FILTER (score <= 2000 AND y = 1) AS fn, count(*) FILTER (score <= 2000 AND y = 0) AS tn FROM s GROUP BY 1)
SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity,
round((tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2, 6) AS balanced_accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc FROM c""")
def confusion(spark, sf):
    s = _scored(spark, sf).withColumn("pred", (F.col("score") > 2000).cast("int"))
    c = stats.confusion(s, ["lang"], "pred", "y")
    return c.select("lang", "tp", "fp", "fn", "tn", *[R(F.col(x)).alias(x) for x in ("precision", "recall", "specificity", "balanced_accuracy", "f1", "mcc")])


@query("WIN12", f"""
WITH {_SCORED}, t AS (SELECT lang, score, sum(y) AS p, count(*) AS m FROM s GROUP BY 1, 2)
SELECT lang, score, sum(p) OVER (PARTITION BY lang ORDER BY score DESC)::BIGINT AS tp, (sum(m - p) OVER (PARTITION BY lang ORDER BY score DESC))::BIGINT AS fp FROM t""")
def roc_points(spark, sf):
    s = stats.score_steps(_scored(spark, sf), ["lang"], "score", "y")
    return s.select("lang", "score", "tp", (F.col("seen") - F.col("tp")).alias("fp"))


@query("WIN11 MLE25", f"""
WITH {_SCORED}, t AS (SELECT lang, score, sum(y) AS p, count(*) AS m FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS seen, sum(p) OVER (PARTITION BY lang) AS pos, sum(m) OVER (PARTITION BY lang) AS n FROM t WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, round(max(tp) FILTER (seen <= n * 0.25)::DOUBLE / max(pos), 6) AS recall_top_quarter FROM c GROUP BY 1 HAVING max(pos) > 0""")
def gain_at_quarter(spark, sf):
    s = stats.score_steps(_scored(spark, sf), ["lang"], "score", "y").filter("pos > 0")
    return s.groupBy("lang").agg(R(F.max(F.when(F.col("seen") <= F.col("n") * 0.25, F.col("tp"))) / F.max("pos")).alias("recall_top_quarter"))


@query("MLE21", f"""
WITH {_SCORED}, k AS (SELECT lang, count(*) AS n, avg(CAST(y = z AS INT)) AS po, avg(y) * avg(z) + (1 - avg(y)) * (1 - avg(z)) AS pe FROM s GROUP BY 1) SELECT lang, n, round((po - pe) / (1 - pe), 6) AS kappa FROM k WHERE pe < 1""")
def kappa(spark, sf):
    return stats.kappa(_scored(spark, sf), ["lang"], "y", "z").filter("kappa IS NOT NULL").select("lang", "n", R(F.col("kappa")).alias("kappa"))


@query("MLE22", f"""
WITH {_SCORED}, c AS (SELECT source, z, count(*) AS c FROM s GROUP BY 1, 2), r AS (SELECT source, sum(c) AS r FROM c GROUP BY 1), k AS (SELECT z, sum(c) AS k FROM c GROUP BY 1), n AS (SELECT sum(c) AS n FROM c),
m AS (SELECT sum(c / n * ln(c * n / (r::DOUBLE * k))) AS mi FROM c JOIN r USING (source) JOIN k USING (z), n), hr AS (SELECT -sum(r / n * ln(r / n)) AS h FROM r, n), hk AS (SELECT -sum(k / n * ln(k / n)) AS h FROM k, n)
SELECT round(mi, 6) AS mi, round(2 * mi / (hr.h + hk.h), 6) AS nmi FROM m, hr, hk""")
def nmi(spark, sf):
    return stats.nmi(_scored(spark, sf), "source", "z").select(R(F.col("mi")).alias("mi"), R(F.col("nmi")).alias("nmi"))


@query("WIN18", """
WITH p AS (SELECT event_type, event_id, (value + 0.5) / 101 / 10 AS p FROM events WHERE value IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY p) AS k, count(*) OVER (PARTITION BY event_type) AS m FROM p)
SELECT event_id, round(least(1.0, min(p * m / k) OVER (PARTITION BY event_type ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""")
def bh_qvalues(spark, sf):
    p = read(spark, sf, "events").filter("value IS NOT NULL").select("event_type", "event_id", ((F.col("value") + 0.5) / 101 / 10).alias("p"))
    return stats.bh_qvalues(p, ["event_type"], "p").select("event_id", R(F.col("q")).alias("q"))


@query("MLE12", f"""
WITH {_SCORED}, g AS (SELECT source, sum(CAST(y = z AS INT)) AS a, count(*) AS t FROM s GROUP BY 1), n AS (SELECT sum(a) AS sa, sum(t) AS st FROM g)
SELECT source, t AS left_out, round((sa - a)::DOUBLE / (st - t), 6) AS share_without FROM g, n""")
def jackknife(spark, sf):
    s = _scored(spark, sf).withColumn("hit", F.col("y") == F.col("z"))
    return stats.jackknife(s, "source", "hit").select("source", "left_out", R(F.col("share_without")).alias("share_without"))


@query("MLE20", f"WITH {_SCORED} SELECT lang, count(*) FILTER (z = 1 AND score <= 2000) AS only_a, count(*) FILTER (z = 0 AND score > 2000) AS only_b, count(*) AS n FROM s GROUP BY 1")
def discordant_pairs(spark, sf):
    b = F.col("score") > 2000
    return _scored(spark, sf).groupBy("lang").agg(F.count_if((F.col("z") == 1) & ~b).alias("only_a"), F.count_if((F.col("z") == 0) & b).alias("only_b"), F.count("*").alias("n"))


@query("AGG32", f"""
WITH {_SCORED}, v AS (SELECT lang, score // 500 AS b, count(*) AS m, sum(y) AS p FROM s GROUP BY 1, 2)
SELECT count(*) AS vectors, count(*) FILTER (p > 0 AND p < m) AS conflicting, round(sum(greatest(p, m - p))::DOUBLE / sum(m), 6) AS ceiling FROM v""")
def attainable_ceiling(spark, sf):
    s = _scored(spark, sf).withColumn("b", F.floor(F.col("score") / 500))
    return stats.ceiling(s, ["lang", "b"], "y").select("vectors", "conflicting", R(F.col("ceiling")).alias("ceiling"))


@query("MLE13 MLE23", f"WITH {_SCORED} SELECT source, count(*) AS n, round(avg(y), 6) AS prevalence, round(greatest(avg(y), 1 - avg(y)), 6) AS majority FROM s GROUP BY 1")
def baselines(spark, sf):
    return _scored(spark, sf).groupBy("source").agg(F.count("*").alias("n"), R(F.avg("y")).alias("prevalence"), R(F.greatest(F.avg("y"), 1 - F.avg("y"))).alias("majority"))


@query("AGG31", """
SELECT event_type, round(corr(r, v), 6) AS spearman FROM (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS r, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS v FROM events) GROUP BY 1""")
def spearman(spark, sf):
    return stats.rank_correlation(read(spark, sf, "events"), ["event_type"], "user_id", "value").select("event_type", R(F.col("rho")).alias("spearman"))


def _poisson_sql(*by):
    u = f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(by)})), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)!r}"
    return "(" + " + ".join(f"({u} >= {c!r})::INT" for c in resample.POISSON) + ")"


def _draws_sql(group, hits, seed):
    return f"""WITH {_SCORED}, g AS (SELECT {group}, sum({hits}) AS a, count(*) AS t FROM s GROUP BY 1), w AS (SELECT draw, a, t, {_poisson_sql(f"'{seed}'", "draw", group)} AS w FROM g, (SELECT unnest(range(2000)) AS draw)),
d AS (SELECT draw, sum(a * w)::DOUBLE / nullif(sum(t * w), 0) AS share FROM w GROUP BY 1)"""


@query("MLE07", _draws_sql("source", "z", 20260803) + " SELECT round(quantile_cont(share, 0.025), 6) AS low, round(quantile_cont(share, 0.975), 6) AS high, count(share) AS used FROM d")
def group_bootstrap(spark, sf):
    d = resample.group_bootstrap(_scored(spark, sf), "source", F.sum("z"), F.count("*"), 2000, 20260803)
    return resample.percentile_interval(d, "share").select(R(F.col("low")).alias("low"), R(F.col("high")).alias("high"), "used")


@query("ext cluster bootstrap", _draws_sql("lang", "y", 7) + " SELECT draw, round(share, 6) AS share FROM d")
def cluster_bootstrap(spark, sf):
    return resample.group_bootstrap(_scored(spark, sf), "lang", F.sum("y"), F.count("*"), 2000, 7).select("draw", R(F.col("share")).alias("share"))


@query("MLE09")
def pair_bootstrap(spark, sf):
    e = read(spark, sf, "events").select("event_type", F.pmod("user_id", F.lit(2)).alias("arm"), "value").dropna()
    return resample.pair_bootstrap(e, "event_type", "arm", "value", 2000, 20260803)


@query("SCA12")
def exact_binomial(spark, sf):
    s = _scored(spark, sf).groupBy("lang").agg(F.sum((F.col("z") == 1).cast("long")).alias("hits"), F.count("*").alias("total"))
    return resample.exact_intervals(s, "lang", "hits", "total")


@query("MLE08", f"""
WITH {_SCORED}, g AS (SELECT source, doc_id // 10 AS block, sum((y = z)::INT) AS a, count(*) AS t FROM s GROUP BY 1, 2),
o AS (SELECT * FROM (SELECT g.*, draw, {_poisson_sql("'20260803'", "draw", "source")} AS o FROM g, (SELECT unnest(range(2000)) AS draw)) WHERE o > 0),
k AS (SELECT *, unnest(range(1, o + 1)) AS k FROM o),
d AS (SELECT draw, sum(a * w)::DOUBLE / nullif(sum(t * w), 0) AS share FROM (SELECT draw, a, t, {_poisson_sql("'20260804'", "draw", "source", "block", "k")} AS w FROM k) GROUP BY 1)
SELECT count(share) AS draws, round(avg(share), 6) AS share, round(quantile_cont(share, 0.05), 6) AS lower FROM d""")
def cluster_bootstrap_lower(spark, sf):
    """Sources, then blocks of documents inside them: the share of agreements and its 5% quantile over 2000 draws."""
    s = _scored(spark, sf).withColumn("block", F.floor(F.col("doc_id") / 10))
    d = resample.two_stage_bootstrap(s, "source", "block", F.sum((F.col("y") == F.col("z")).cast("long")), F.count("*"), 2000, 20260803)
    return d.agg(F.count("share").alias("draws"), R(F.avg("share")).alias("share"), R(F.percentile("share", F.lit(0.05))).alias("lower"))


def _binary(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    one = lambda p: p.cast("int")
    return d.select("doc_id", "source", "lang", F.col("quality").alias("y"), one(F.col("n_chars") > 2000).alias("long"), one(F.contains("text", F.lit("!"))).alias("loud"), one(F.contains("text", F.lit("http"))).alias("linked"))


def _bayes_sql(group):
    p = lambda f, c: f"(t.{f}_{c} - o.{f}_{c} + 1) / (t.n{c} - o.n{c} + 2)::DOUBLE"
    sums = ", ".join([f"count(*) FILTER (y = {c}) AS n{c}" for c in (0, 1)] + [f"coalesce(sum({f}) FILTER (y = {c}), 0) AS {f}_{c}" for f in ("long", "loud", "linked") for c in (0, 1)])
    score = "ln((t.n1 - o.n1 + 1) / (t.n0 - o.n0 + 1)::DOUBLE)" + "".join(f" + CASE WHEN d.{f} = 1 THEN ln(({p(f, 1)}) / ({p(f, 0)})) ELSE ln((1 - {p(f, 1)}) / (1 - {p(f, 0)})) END" for f in ("long", "loud", "linked"))
    return f"""
WITH d AS (SELECT {group}, quality AS y, (n_chars > 2000)::INT AS long, contains(text, '!')::INT AS loud, contains(text, 'http')::INT AS linked FROM documents JOIN labels USING (doc_id)),
t AS (SELECT {sums} FROM d), o AS (SELECT {group}, {sums} FROM d GROUP BY 1)
SELECT d.{group}, count(*) AS n, count(*) FILTER (CASE WHEN {score} > 0 THEN 1 ELSE 0 END = y) AS hits FROM d JOIN o ON o.{group} = d.{group}, t GROUP BY 1"""


@query("MLE10", _bayes_sql("source"))
def leave_one_source_out(spark, sf):
    return models.leave_one_out_bayes(_binary(spark, sf), [], "source", ["long", "loud", "linked"], "y")


@query("MLE11", _bayes_sql("lang"))
def leave_one_language_out(spark, sf):
    return models.leave_one_out_bayes(_binary(spark, sf), [], "lang", ["long", "loud", "linked"], "y")


@query("MLE26")
def permutation_test(spark, sf):
    """The leave-one-source-out procedure against 200 shuffles of its labels."""
    return models.permutation_test(_binary(spark, sf), "doc_id", "source", ["long", "loud", "linked"], "y", 200, 20260803)


@query("ext forest and logistic folds")
def group_cv_auc(spark, sf):
    """Group-disjoint folds: logistic regression and a forest on embeddings, label 0 or 1 against parity of the id block."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    e = read(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") < 5).cast("double").alias("y"), F.pmod(F.floor(F.col("vec_id") / 50), F.lit(3)).alias("fold"))
    out = None
    for fold in range(3):
        train, test = e.filter(F.col("fold") != fold), e.filter(F.col("fold") == fold)
        for name, model in (("logistic", LogisticRegression(labelCol="y", maxIter=20)), ("forest", RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=5, seed=1))):
            from pyspark.ml.functions import vector_to_array

            got = model.fit(train).transform(test).select(F.lit(name).alias("learner"), F.lit(fold).alias("fold"), vector_to_array("probability")[1].alias("score"), F.col("y").cast("int").alias("y"))
            out = got if out is None else out.union(got)
    return stats.ranking_metrics(out, ["learner", "fold"], "score", "y")


@query("AGG34", f"""
WITH {_SCORED}, r AS (SELECT *, score // 500 AS b, unnest([0, 1, 2, 3]) AS step FROM s),
k AS (SELECT * FROM r WHERE step = 0 OR step = 1 AND score > 300 OR step = 2 AND score > 300 AND lang <> 'de' OR step = 3 AND score > 300 AND lang <> 'de' AND z = 1),
c AS (SELECT step, lang, b, count(*) AS n, sum(y) AS p FROM k GROUP BY 1, 2, 3), o AS (SELECT step, sum(n) AS n, sum(p) AS p, sum(greatest(p, n - p)) AS best FROM c GROUP BY 1), g AS (SELECT step, count(DISTINCT source) AS groups FROM k GROUP BY 1)
SELECT o.step, ['labelled', 'long', 'not de', 'good'][o.step + 1] AS name, CAST(n AS BIGINT) AS n, groups, round(p / n::DOUBLE, 6) AS prevalence, round(greatest(p / n::DOUBLE, 1 - p / n::DOUBLE), 6) AS majority, round(best / n::DOUBLE, 6) AS ceiling FROM o JOIN g ON g.step = o.step""")
def restriction_funnel(spark, sf):
    steps = [("labelled", F.lit(True)), ("long", F.col("score") > 300), ("not de", F.col("lang") != "de"), ("good", F.col("z") == 1)]
    s = _scored(spark, sf).withColumn("b", F.floor(F.col("score") / 500))
    out = stats.restriction_funnel(s, steps, "source", "y", ["lang", "b"])
    return out.select("step", "name", "n", "groups", *(R(F.col(c)).alias(c) for c in ("prevalence", "majority", "ceiling")))

"""Screening queries: rules, verdicts, funnels, shares of projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, joins, rules, stats
from ..sources.tables import read
from .registry import query

R = lambda c, n=6: F.round(c, n)
HARD, SOFT = ["short_text", "licence", "not_english"], ["long_text", "shouting"]
_FIRED = """WITH f AS (SELECT doc_id, source, lang, list_sort(list_filter([CASE WHEN n_chars < 500 THEN 'short_text' END, CASE WHEN contains(lower(text), 'license') THEN 'licence' END, CASE WHEN lang <> 'en' THEN 'not_english' END,
 CASE WHEN n_chars > 5000 THEN 'long_text' END, CASE WHEN contains(text, '!') THEN 'shouting' END], lambda x: x IS NOT NULL)) AS rules FROM documents),
v AS (SELECT *, list_filter(rules, lambda x: list_contains(['short_text', 'licence', 'not_english'], x)) AS ex, list_filter(rules, lambda x: list_contains(['long_text', 'shouting'], x)) AS fl FROM f)"""


def _verdicts(spark, sf):
    d = read(spark, sf, "documents")
    fired = rules.firings(d, "doc_id", {"short_text": F.col("n_chars") < 500, "licence": F.contains(F.lower("text"), F.lit("license")), "not_english": F.col("lang") != "en", "long_text": F.col("n_chars") > 5000, "shouting": F.contains("text", F.lit("!"))})
    return rules.group_verdict(fired, HARD, SOFT)


@query("RUL01 RUL02", _FIRED + " SELECT doc_id, array_to_string(ex, ',') AS excluded_by, array_to_string(fl, ',') AS flagged_by, len(ex) = 0 AS eligible FROM v")
def hard_soft_verdict(spark, sf):
    return _verdicts(spark, sf).select("doc_id", F.array_join("excluded_by", ",").alias("excluded_by"), F.array_join("flagged_by", ",").alias("flagged_by"), "eligible")


@query("AGG11 AGG12", _FIRED + ", x AS (SELECT unnest(rules) AS rule FROM v) SELECT rule, count(*) AS n FROM x GROUP BY 1")
def rule_counts(spark, sf):
    return rules.rule_counts(_verdicts(spark, sf))


@query("AGG12", _FIRED + " SELECT CASE WHEN len(ex) = 0 THEN 'eligible' ELSE 'excluded' END AS verdict, count(*) AS n, count(*) FILTER (len(fl) > 0) AS flagged FROM v GROUP BY 1")
def verdict_counts(spark, sf):
    return _verdicts(spark, sf).groupBy(F.when(F.col("eligible"), "eligible").otherwise("excluded").alias("verdict")).agg(F.count("*").alias("n"), F.count_if(F.size("flagged_by") > 0).alias("flagged"))


@query("SCA28", _FIRED + " SELECT source, array_to_string(list_sort(list_distinct(flatten(list(rules)))), '; ') AS reasons FROM v GROUP BY 1", )
def reasons(spark, sf):
    v = _verdicts(spark, sf).join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    sets = v.select("source", F.explode_outer("rules").alias("rule")).groupBy("source").agg(F.collect_set("rule").alias("r"))
    return sets.select("source", F.array_join(F.array_sort("r"), "; ").alias("reasons"))


@query("RUL03 RUL04 R15 R20 R13 SET04", """
WITH d AS (SELECT doc_id, source, lang, n_chars, CASE WHEN n_chars < 500 THEN 'short_text' END AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, list_sort(list_distinct(list_filter([l.h, r.h, CASE WHEN l.source = 'src3' THEN 'R0' END], lambda x: x IS NOT NULL))) AS fired, r.n_chars - l.n_chars AS d, r.lang <> l.lang AS form, (r.n_chars % 5) <> (l.n_chars % 5) AS bind FROM d l JOIN d r ON l.source = r.source AND r.k = l.k + 1)
SELECT a, b, CASE WHEN len(fired) > 0 THEN array_to_string(fired, ',') WHEN d = 0 THEN 'R15' WHEN form THEN 'R20' WHEN bind THEN 'R13' ELSE '' END AS rules,
CASE WHEN len(fired) > 0 OR d = 0 OR form OR bind THEN 'excluded' ELSE 'eligible' END AS verdict FROM p""")
def pair_verdict(spark, sf):
    from pyspark.sql import Window

    none = F.array().cast("array<string>")
    w = Window.partitionBy("source").orderBy("doc_id")
    d = read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", F.when(F.col("n_chars") < 500, F.array(F.lit("short_text"))).otherwise(none).alias("h"))
    side = F.struct("doc_id", "lang", "n_chars", "h")
    p = d.withColumn("r", F.lead(side).over(w)).filter("r IS NOT NULL")
    p = p.select(F.col("doc_id").alias("a"), F.col("r.doc_id").alias("b"), F.col("h").alias("l_rules"), F.col("r.h").alias("r_rules"), F.when(F.col("source") == "src3", F.array(F.lit("R0"))).otherwise(none).alias("group_rules"), (F.col("r.n_chars") - F.col("n_chars")).alias("d"), (F.col("r.lang") != F.col("lang")).alias("form"), (F.pmod("r.n_chars", F.lit(5)) != F.pmod("n_chars", F.lit(5))).alias("bind"))
    return rules.pair_verdict(p, HARD, F.col("d") == 0, F.col("form"), F.col("bind")).select("a", "b", F.array_join("verdict_rules", ",").alias("rules"), "verdict")


@query("AGG15 AGG33 AGG34 RUL08", """
WITH s AS (SELECT unnest(['all', 'english', 'long', 'clean']) AS step), d AS (SELECT *, lang = 'en' AS e, n_chars >= 500 AS l, NOT contains(lower(text), 'license') AS c FROM documents)
SELECT step, count(*) AS rows, count(DISTINCT source) AS n_source FROM s JOIN d ON step = 'all' OR (step = 'english' AND e) OR (step = 'long' AND e AND l) OR (step = 'clean' AND e AND l AND c) GROUP BY 1""")
def funnel(spark, sf):
    e, l, c = F.col("lang") == "en", F.col("n_chars") >= 500, ~F.contains(F.lower("text"), F.lit("license"))  # noqa: E741
    flags = read(spark, sf, "documents").select("source", e.alias("e"), (e & l).alias("l"), (e & l & c).alias("c"))
    return rules.funnel(flags, {"all": F.lit(True), "english": F.col("e"), "long": F.col("l"), "clean": F.col("c")}, ["source"])


@query("AGG01 AGG13 AGG14 JOI01", """
SELECT n.n_name, count(*) AS orders, round(avg(o.o_totalprice), 4) AS mean, count(DISTINCT o.o_custkey) AS customers, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1""")
def project_share(spark, sf):
    from pyspark.sql import Window

    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = o.groupBy("n_name").agg(F.count("*").alias("orders"), R(F.avg("o_totalprice"), 4).alias("mean"), F.count_distinct("o_custkey").alias("customers"))
    return g.withColumn("share", R(F.col("orders") / F.sum("orders").over(Window.partitionBy()), 4))


@query("AGG03 AGG04 AGG02", """
WITH c AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, count(*) AS items, round(max(n)::DOUBLE / sum(n), 6) AS top_share, round(sum(n)::DOUBLE * sum(n)::DOUBLE / sum(n * n)::DOUBLE, 4) AS effective FROM c GROUP BY 1""")
def effective_number(spark, sf):
    e = stats.effective_number(read(spark, sf, "orders"), ["o_orderpriority"], "o_custkey")
    return e.select("o_orderpriority", "items", R(F.col("top_share")).alias("top_share"), R(F.col("effective"), 4).alias("effective"))


@query("AGG16 AGG20 AGG21", """
SELECT count(*) AS total, count(DISTINCT l_orderkey) AS scopes, count(*) FILTER (l_quantity > 25) AS measurable, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS held, round(avg(CAST(l_discount <> 0 AS INT)), 4) AS nonzero_share FROM lineitem""")
def totals(spark, sf):
    return read(spark, sf, "lineitem").agg(F.count("*").alias("total"), F.count_distinct("l_orderkey").alias("scopes"), F.count_if(F.col("l_quantity") > 25).alias("measurable"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("held"), R(F.avg((F.col("l_discount") != 0).cast("int")), 4).alias("nonzero_share"))


@query("AGG18", """
WITH v AS (SELECT d.doc_id, l.quality = 1 AS verified, l.toxic AS errors FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) FILTER (verified IS NOT NULL) AS seen, count(*) FILTER (verified AND errors = 0) AS clean, count(*) FILTER (verified IS NOT NULL AND (NOT verified OR coalesce(errors, 0) > 0)) AS unclean, count(*) FILTER (verified IS NULL) AS unknown FROM v""")
def verification_summary(spark, sf):
    v = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left").select((F.col("quality") == 1).alias("v"), F.col("toxic").alias("e"))
    known = F.col("v").isNotNull()
    return v.agg(F.count_if(known).alias("seen"), F.count_if(F.col("v") & (F.col("e") == 0)).alias("clean"), F.count_if(known & (~F.col("v") | (F.coalesce("e", F.lit(0)) > 0))).alias("unclean"), F.count_if(~known).alias("unknown"))


@query("AGG19", """
SELECT source, min(n_chars) AS low, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median, max(n_chars) AS high, count(DISTINCT lang) AS langs FROM documents GROUP BY 1""")
def upper_median(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("source")
    d = read(spark, sf, "documents").select("source", "lang", "n_chars").withColumns({"r": F.row_number().over(w.orderBy("n_chars")), "n": F.count("*").over(w)})
    return d.groupBy("source").agg(F.min("n_chars").alias("low"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("n_chars"))).alias("upper_median"), F.max("n_chars").alias("high"), F.count_distinct("lang").alias("langs"))


@query("AGG25 SRT03 SRT01", "SELECT source, count(*) AS n FROM documents WHERE n_chars < 1000 GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def worst_groups(spark, sf):
    return read(spark, sf, "documents").filter("n_chars < 1000").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("RUL10 JOI20", """
SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1 HAVING count(*) < 2""")
def no_pair(spark, sf):
    barred = read(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf, "orders").join(barred, "o_custkey", "left_anti").groupBy("o_custkey").count().filter("count < 2").select("o_custkey")


@query("RUL09 JOI27", """
WITH e AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), h AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000)
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT k FROM e) AND c_custkey NOT IN (SELECT k FROM h)""")
def ship_set(spark, sf):
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer").select("c_custkey")
    key = F.col("o_custkey").alias("c_custkey")
    return c.join(o.filter("o_orderstatus = 'O'").select(key), "c_custkey", "left_semi").join(o.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 250000").select(key), "c_custkey", "left_anti")


@query("RUL05 WIN04", "SELECT source, arg_min(doc_id, (CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id)) AS representative FROM documents GROUP BY 1")
def representative(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct((F.col("lang") != "en").cast("int"), "doc_id")).alias("representative"))


@query("RUL11", """
WITH v AS (SELECT user_id, CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS severity, event_type FROM events)
SELECT user_id, arg_max(event_type, (severity, event_type)) AS verdict, max(severity)::BIGINT AS severity FROM v GROUP BY 1""")
def severity_fold(spark, sf):
    s = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1).otherwise(0).cast("long")
    v = read(spark, sf, "events").select("user_id", "event_type", s.alias("s"))
    return v.groupBy("user_id").agg(F.max_by("event_type", F.struct("s", "event_type")).alias("verdict"), F.max("s").alias("severity"))


@query("ext rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::BIGINT AS g1, grouping(o_orderpriority)::BIGINT AS g2 FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_strata(spark, sf):
    return read(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"))


@query("FLT01 FLT05 AGG10", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(max(l_quantity), 2) AS most, count(*) FILTER (abs(l_discount - 0.05) < 0.011) AS near, count(*) FILTER (l_returnflag = 'R') AS is_r, count(*) FILTER (l_returnflag = 'N') AS is_n FROM lineitem GROUP BY 1, 2""")
def strata(spark, sf):
    f = F.col("l_returnflag")
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), R(F.max("l_quantity"), 2).alias("most"), F.count_if(F.abs(F.col("l_discount") - 0.05) < 0.011).alias("near"), F.count_if(f == "R").alias("is_r"), F.count_if(f == "N").alias("is_n"))


@query("JOI15", """
WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN -1 ELSE 0 END AS expected, sign(l_discount - l_tax) AS got FROM lineitem)
SELECT CASE WHEN expected = 0 THEN 'unjoinable' WHEN got = expected THEN 'clean' WHEN got = 0 THEN 'weak' ELSE 'label_disagree' END AS outcome, count(*) AS n FROM x GROUP BY 1""")
def expectation_audit(spark, sf):
    e = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    x = read(spark, sf, "lineitem").select(e.alias("e"), F.signum(F.col("l_discount") - F.col("l_tax")).alias("g"))
    return x.groupBy(F.when(F.col("e") == 0, "unjoinable").when(F.col("g") == F.col("e"), "clean").when(F.col("g") == 0, "weak").otherwise("label_disagree").alias("outcome")).agg(F.count("*").alias("n"))


@query("SCA03", """
WITH s AS (SELECT unnest(range(1, (SELECT count(DISTINCT c_custkey) + 11 FROM customer))) AS s)
SELECT CASE WHEN s < 1000000 THEN lpad(CAST(s AS VARCHAR), 6, '0') ELSE CAST(s AS VARCHAR) END AS free_id FROM s WHERE s NOT IN (SELECT c_custkey FROM customer) ORDER BY s LIMIT 10""")
def lowest_free_ids(spark, sf):
    """Of all customers' ids: among one more than are taken, plus nine, ten are free at least. The ten are the feature."""
    taken = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    free = joins.work_list(spark.range(1, taken.distinct().count() + 11), taken, ["id"]).orderBy("id").limit(10)
    s = F.col("id").cast("string")
    return free.select(F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s).alias("free_id"))


@query("RUL20 JOI29", """
WITH RECURSIVE r(node, level) AS (SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END FROM nation UNION SELECT n.n_nationkey, r.level FROM r JOIN nation n ON n.n_nationkey = r.node + 5)
SELECT node::BIGINT AS node, max(level)::BIGINT AS level FROM r GROUP BY 1""")
def region_propagation(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_regionkey") == 2).cast("long").alias("level"))
    return facts.propagate(n, n.select((F.col("node") - 5).alias("src"), "node"))

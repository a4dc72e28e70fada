"""Fact queries: branches, shims, imports, fixtures, forests, checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, models, stats
from ..sources.tables import read
from .registry import query

R = lambda c, n=6: F.round(c, n)


@query("RUL14 SCA25", """
WITH b AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS t, count(*) FILTER (event_type = 'click') AS e, count(*) FILTER (event_type = 'error') % 3 AS u, user_id % 10 = 3 AS lazy FROM events GROUP BY 1)
SELECT user_id, CASE WHEN lazy THEN 'none' WHEN t >= e + u THEN CASE WHEN t > e THEN 'then' ELSE 'none' END WHEN e >= t + u THEN 'else' ELSE 'none' END AS choice FROM b""")
def branch_choice(spark, sf):
    n = lambda k: F.count_if(F.col("event_type") == k)
    b = read(spark, sf, "events").groupBy("user_id").agg(n("view").alias("t"), n("click").alias("e"), (n("error") % 3).alias("u")).withColumn("lazy", F.pmod("user_id", F.lit(10)) == 3)
    return facts.branch_choice(b, ["user_id"], "t", "e", "u", "lazy").select("user_id", "choice")


@query("R16 AGG29 JOI30", "SELECT source, bool_or(lang = 'es') AND count(*) FILTER (n_chars < 800) > 0 AS fires, count(*) FILTER (n_chars < 800) AS waiting FROM documents GROUP BY 1")
def unfilled_fixtures(spark, sf):
    d = read(spark, sf, "documents").select("source", F.when(F.col("lang") == "es", "none").otherwise("known").alias("origin"), (F.col("n_chars") < 800).cast("long").alias("open"))
    return facts.unfilled(d, "source", "origin", "open")


@query("R19 RUL23 RUL35", """
WITH c AS (SELECT user_id AS k, event_type AS name, CASE WHEN event_id % 3 = 0 THEN 'child' WHEN event_id % 3 = 1 THEN 'body' ELSE 'extra' END AS param FROM events),
s AS (SELECT * FROM (VALUES ('view', ['child']), ('click', ['child', 'body'])) t(name, params)), h AS (SELECT c.k, c.name || '.' || param AS d FROM c JOIN s USING (name) WHERE NOT list_contains(params, param))
SELECT k, coalesce((SELECT string_agg(DISTINCT d, ',' ORDER BY d) FROM h WHERE h.k = a.k), '') AS drops FROM (SELECT DISTINCT k FROM c) a""")
def shim_drops(spark, sf):
    e = read(spark, sf, "events")
    m = F.pmod("event_id", F.lit(3))
    calls = e.select(F.col("user_id").alias("k"), F.col("event_type").alias("name"), F.when(m == 0, "child").when(m == 1, "body").otherwise("extra").alias("param"))
    made = spark.createDataFrame([("view", ["child"]), ("click", ["child", "body"])], "name string, params array<string>")
    return facts.shim_drops(calls, made, "k", "name").select("k", F.array_join("drops", ",").alias("drops"))


@query("RUL31", """
SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_orderkey + 40) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM orders) WHERE e > o_orderkey""")
def overlapping_edits(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") + 40).alias("e"))
    return facts.overlapping_edits(o, "o_custkey", "o_orderkey", "e").select("o_custkey", "o_orderkey")


@query("RUL32 RUL39 SCA19", """
SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey = 0 THEN 'rebuild' WHEN n_regionkey = 1 THEN 'lifecycle' ELSE 'none' END AS region, '_' || lower(substr(n_name, 1, 1)) || substr(n_name, 2) || CASE WHEN n_regionkey = 2 THEN 'State' ELSE '' END AS field, '''' || n_name || '''' AS source FROM nation""")
def member_names(spark, sf):
    n, r = F.col("n_name"), F.col("n_regionkey")
    plain = F.concat(F.lit("_"), F.lower(F.substring(n, 1, 1)), F.substring(n, 2, 99))
    taken = F.when(r == 2, F.array(plain)).otherwise(F.array().cast("array<string>"))
    region = facts.region_seed(F.when(r == 1, "field").otherwise("method"), n, F.when(r == 0, "Widget").otherwise("void"))
    return read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), region.alias("region"), facts.state_name(n, taken).alias("field"), facts.literal(n, F.lit("string")).alias("source"))


@query("RUL15", """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'recovered' WHEN s_acctbal > 5000 THEN 'policy' WHEN s_nationkey < 5 THEN 'enum' WHEN s_nationkey < 10 THEN 'collection' ELSE 'none' END AS origin FROM supplier""")
def value_origin(spark, sf):
    v = lambda c: F.when(c, F.col("s_name"))
    r = facts.resolve(v(F.pmod("s_suppkey", F.lit(7)) == 0), v(F.col("s_acctbal") > 5000), v(F.col("s_nationkey") < 5), v(F.col("s_nationkey") < 10))
    return read(spark, sf, "supplier").select("s_suppkey", r["origin"].alias("origin"))


@query("RUL37 JOI29", """
WITH m AS (SELECT o_custkey AS c_custkey, bool_or(o_orderstatus = 'P') AS via FROM orders GROUP BY 1) SELECT c_custkey, c_mktsegment = 'BUILDING' OR coalesce(via, false) AS reaches FROM customer LEFT JOIN m USING (c_custkey)""")
def reaches_build(spark, sf):
    b = read(spark, sf, "customer").select(F.col("c_custkey").alias("binding"), (F.col("c_mktsegment") == "BUILDING").alias("direct"))
    m = read(spark, sf, "orders").select(F.col("o_custkey").alias("binding"), F.col("o_orderkey").alias("field"), (F.col("o_orderstatus") == "P").alias("field_used"))
    return facts.reaches_build(b, m).select(F.col("binding").alias("c_custkey"), "reaches")


@query("INC26", """
WITH a AS (SELECT source, CAST(count(*) AS BIGINT) AS d, list(DISTINCT lang) AS n FROM documents WHERE n_chars > 1500 GROUP BY 1), s AS (SELECT source, CAST(count(*) AS BIGINT) AS d, list(DISTINCT lang) AS n FROM documents WHERE n_chars > 2500 AND source <> 'src1' GROUP BY 1)
SELECT a.source, CASE WHEN s.source IS NULL THEN 'new' WHEN a.d = s.d THEN 'same' WHEN list_sort(a.n) <> list_sort(s.n) THEN 'changed' ELSE 'unknown' END AS action FROM a LEFT JOIN s USING (source)""")
def authored_store(spark, sf):
    g = lambda f: read(spark, sf, "documents").filter(f).groupBy("source").agg(F.count("*").alias("d"), F.collect_set("lang").alias("n"))
    return facts.adopt(g("n_chars > 1500"), g("n_chars > 2500 AND source <> 'src1'"), "source", "d", "n")


@query("SRC16 SRC31 INC04", """
WITH e AS (SELECT event_id, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events), n AS (SELECT user_id, list(struct_pack(id := event_id, k := k, status := event_type) ORDER BY event_id) AS code_rows FROM e GROUP BY 1), x AS (SELECT user_id, unnest(code_rows) AS r FROM n)
SELECT user_id, r.id AS id, r.k AS k FROM x WHERE r.status = 'purchase' AND r.k IS NOT NULL""")
def code_rows(spark, sf):
    k = F.from_json("props", "k BIGINT")["k"]
    nested = read(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_id").alias("id"), k.alias("k"), F.col("event_type").alias("status"))).alias("code_rows"))
    return nested.select("user_id", F.explode("code_rows").alias("r")).filter("r.status = 'purchase' AND r.k IS NOT NULL").select("user_id", "r.id", "r.k")


@query("SRC18 SRC30", """
SELECT stem, page_id FROM (SELECT page_id, string_split(url, '/')[-1] AS stem, row_number() OVER (PARTITION BY string_split(url, '/')[-1] ORDER BY page_id) AS r FROM pages) WHERE r = 1""")
def static_index(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.element_at(F.split("url", "/", -1), -1).alias("stem"))
    return p.groupBy("stem").agg(F.min("page_id").alias("page_id"))


@query("FLT19 SNK15 SNK19", """
SELECT source, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (n_chars < 200) AS problems FROM documents GROUP BY 1""")
def problem_lists(spark, sf):
    bad = F.array_sort(F.collect_list(F.when(F.col("n_chars") < 200, F.col("doc_id"))))
    g = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), bad.alias("b"))
    return g.select("source", "n", F.nullif(F.array_join(F.transform("b", lambda x: x.cast("string")), ","), F.lit("")).alias("problems"))


@query("INC14", """
SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS unpaired, (SELECT count(*) FROM customer) AS baseline""")
def paired_tables(spark, sf):
    o, c, l = (read(spark, sf, t) for t in ("orders", "customer", "lineitem"))  # noqa: E741
    a = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("orphans"))
    b = l.select("l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count_distinct("l_orderkey").alias("unpaired"))
    return a.crossJoin(b).crossJoin(c.agg(F.count("*").alias("baseline")))


def _forest(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") < 3).cast("double").alias("y")).filter("x IS NOT NULL")
    return e, RandomForestClassifier(labelCol="y", numTrees=10, maxDepth=4, seed=1).fit(e.withColumn("features", array_to_vector("x")))


@query("MLE29 SNK18")
def forest_from_arrays(spark, sf):
    e, model = _forest(spark, sf)
    return models.score_forest(e, models.tree_arrays(model), "x", ["vec_id"])


@query("MLE27 MLE13", """
WITH s AS (SELECT d.n_chars AS a, length(d.text) - length(replace(d.text, ' ', '')) AS b, l.toxic AS y FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT 'chars' AS feature, a AS score, y FROM s UNION ALL SELECT 'spaces', b, y FROM s), t AS (SELECT feature, score, sum(y) AS p, count(*) AS m FROM p GROUP BY 1, 2),
c AS (SELECT *, sum(m - p) OVER (PARTITION BY feature ORDER BY score) - (m - p) AS below, sum(p) OVER (PARTITION BY feature) AS pos, sum(m) OVER (PARTITION BY feature) AS n FROM t)
SELECT feature, round(sum(p * (below + (m - p) / 2.0)) / (max(pos) * (max(n) - max(pos))), 6) AS auc FROM c GROUP BY 1""")
def ablation_single_features(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    s = d.select("y", F.expr("stack(2, 'chars', n_chars, 'spaces', CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT)) AS (feature, score)"))
    return stats.ranking_metrics(s, ["feature"], "score", "y").select("feature", R(F.col("auc")).alias("auc"))

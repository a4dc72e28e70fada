"""Contrast queries: pairs of versions, deltas, revisions, comparisons of states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, ordered, stats
from ..sources.tables import events, read
from .registry import query

R = lambda c, n=6: F.round(c, n)
_LINE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, CAST(l_discount * 100 AS BIGINT) AS d FROM lineitem"
_PAIRS = f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q, d) AS k FROM ({_LINE})),
p AS (SELECT l.l_orderkey, l.l_linenumber AS a, r.l_linenumber AS b, r.q - l.q AS dq, r.d - l.d AS dd, r.k = l.k + 1 AS adjacent FROM k l JOIN k r ON l.l_orderkey = r.l_orderkey AND l.k < r.k)"""


def _pairs(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_discount") * 100).cast("long").alias("d"))  # noqa: E741
    return joins.vector_delta(joins.group_pairs(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "q", "d"], ["l_linenumber", "q", "d"]), ["q", "d"])


@query("JOI03 JOI04 JOI06 SCA10 WIN03", _PAIRS + " SELECT l_orderkey, a::BIGINT AS a, b::BIGINT AS b, dq, dd, adjacent FROM p")
def all_pairs_delta(spark, sf):
    return _pairs(spark, sf).select("l_orderkey", F.col("l_l_linenumber").cast("long").alias("a"), F.col("r_l_linenumber").cast("long").alias("b"), F.col("d_q").alias("dq"), F.col("d_d").alias("dd"), "adjacent")


@query("FLT03 FLT04 R15 AGG17", _PAIRS + " SELECT adjacent, count(*) AS pairs, count(*) FILTER (dq = 0 AND dd = 0) AS zero, count(*) FILTER (abs(dq) > 20) AS decisive FROM p GROUP BY 1")
def zero_delta(spark, sf):
    return _pairs(spark, sf).groupBy("adjacent").agg(F.count("*").alias("pairs"), F.count_if(~stats.any_moves(["d_q", "d_d"])).alias("zero"), F.count_if(F.abs("d_q") > 20).alias("decisive"))


@query("SCA13", _PAIRS + """
SELECT l_orderkey, a::BIGINT AS a, b::BIGINT AS b, CAST(coalesce(nullif(sign(dq), 0), nullif(sign(dd), 0), 0) AS BIGINT) AS lex2, CAST(sign(sign(dq) + sign(dd)) AS BIGINT) AS vote2 FROM p""")
def sign_rules(spark, sf):
    s = lambda c: F.signum(c).cast("long")
    lex = F.coalesce(F.nullif(s("d_q"), F.lit(0)), F.nullif(s("d_d"), F.lit(0)), F.lit(0))
    return _pairs(spark, sf).select("l_orderkey", F.col("l_l_linenumber").cast("long").alias("a"), F.col("r_l_linenumber").cast("long").alias("b"), lex.cast("long").alias("lex2"), s(s("d_q") + s("d_d")).alias("vote2"))


@query("ext both orientations", _PAIRS + """
, s AS (SELECT dq AS x, dd AS y FROM p UNION ALL SELECT -dq, -dd FROM p) SELECT count(*) AS readings, count(*) FILTER (x > 0) AS slower, count(*) FILTER (x > 0 AND y > 0) AS agree, count(*) FILTER (x = 0) AS zero FROM s""")
def both_orientations(spark, sf):
    p = _pairs(spark, sf).select(F.col("d_q").alias("x"), F.col("d_d").alias("y"))
    return p.union(p.select(-F.col("x"), -F.col("y"))).agg(F.count("*").alias("readings"), F.count_if(F.col("x") > 0).alias("slower"), F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("agree"), F.count_if(F.col("x") == 0).alias("zero"))


@query("AGG28", _PAIRS + """
, m AS (SELECT l_orderkey, 'q' AS feature, dq <> 0 AS moves FROM p UNION ALL SELECT l_orderkey, 'd', dd <> 0 FROM p)
SELECT feature, count(*) AS pairs, count(*) FILTER (moves) AS moved, round(avg(CAST(moves AS INT)), 6) AS share, count(DISTINCT l_orderkey) FILTER (moves) AS scopes FROM m GROUP BY 1""")
def moving_features(spark, sf):
    m = _pairs(spark, sf).select("l_orderkey", F.expr("stack(2, 'q', d_q, 'd', d_d) AS (feature, delta)")).withColumn("moves", F.col("delta") != 0)
    return m.groupBy("feature").agg(F.count("*").alias("pairs"), F.count_if("moves").alias("moved"), R(F.avg(F.col("moves").cast("int"))).alias("share"), F.count_distinct(F.when(F.col("moves"), F.col("l_orderkey"))).alias("scopes"))


@query("SRT10 SRT09", _PAIRS + " SELECT l_orderkey, a::BIGINT AS a, b::BIGINT AS b FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(dq) DESC, a, b) AS r FROM p) WHERE r = 1")
def widest_pair(spark, sf):
    p = ordered.first_of(_pairs(spark, sf), ["l_orderkey"], [F.desc(F.abs("d_q")), "l_l_linenumber", "r_l_linenumber"])
    return p.select("l_orderkey", F.col("l_l_linenumber").cast("long").alias("a"), F.col("r_l_linenumber").cast("long").alias("b"))


@query("WIN05 JOI05", """
WITH c AS (SELECT user_id, event_id, event_type, row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CASE WHEN ch THEN 'new' ELSE 'unchanged' END AS status, 'rev_' || lpad(CAST(sum(CAST(ch AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR), 3, '0') AS rev FROM c""")
def change_detection(spark, sf):
    return ordered.revisions(read(spark, sf, "events"), ["user_id"], ["event_id"], "event_type").select("event_id", "status", "rev")


@query("WIN06", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS ordinal FROM conversations")
def ordinals(spark, sf):
    return ordered.ordinal(read(spark, sf, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", F.col("ordinal").cast("long").alias("ordinal"))


@query("WIN04 AGG24 R7 SCA04", """
SELECT doc_id, sha256(text) AS sha, min(doc_id) OVER (PARTITION BY text) AS lowest, doc_id > min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents""")
def duplicate_lowest_id(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    low = ordered.lowest_of_group(d, "sha", "doc_id")
    return d.join(low, "doc_id").select("doc_id", "sha", "lowest", (F.col("doc_id") > F.col("lowest")).alias("duplicate"))


@query("JOI16 JOI17 JOI18 JOI32", """
WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 13 <> 0
 UNION ALL SELECT p_partkey + 1000000, p_size, p_brand FROM part WHERE p_partkey % 17 = 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_size <> b.p_size OR a.p_brand <> b.p_brand THEN 'changed' ELSE 'same' END AS status,
CASE WHEN a.p_partkey IS NULL OR b.p_partkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.p_size <> b.p_size THEN 'p_size' END, CASE WHEN a.p_brand <> b.p_brand THEN 'p_brand' END) END AS fields
FROM part a FULL JOIN b USING (p_partkey)""")
def full_compare(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    k = F.col("p_partkey")
    b = p.filter(k % 13 != 0).select(k, F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), F.when(k % 11 == 0, "x").otherwise(F.col("p_brand")).alias("p_brand"))
    b = b.unionByName(p.filter(k % 17 == 0).withColumn("p_partkey", k + 1_000_000))
    return joins.full_compare(p, b, ["p_partkey"], ["p_size", "p_brand"]).select("p_partkey", "status", F.array_join("fields", ",").alias("fields"))


@query("SET05 SET04 R13 SCA15", """
WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 0)) AS a, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 1)) AS b FROM events GROUP BY 1)
SELECT user_id, CASE WHEN len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) > 0 AND len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) > 0 THEN 'both'
WHEN len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) > 0 THEN 'added' WHEN len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) > 0 THEN 'removed' ELSE 'identical' END AS relation FROM s""")
def binding_relation(spark, sf):
    e = read(spark, sf, "events")
    even = F.pmod("event_id", F.lit(2)) == 0
    s = e.groupBy("user_id").agg(F.collect_set(F.when(even, F.col("event_type"))).alias("a"), F.collect_set(F.when(~even, F.col("event_type"))).alias("b"))
    return s.select("user_id", T.relation(F.array_except("b", "a"), F.array_except("a", "b")).alias("relation"))


@query("FLT13", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= (SELECT min(ts) FROM events)) WHERE r <= 5""")
def most_recent(spark, sf):
    from pyspark.sql import Window

    e = events(spark, sf)
    return e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id")))).filter("r <= 5").select("user_id", "event_id")


@query("JOI21 SET02 SET03", "SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def closure_only(spark, sf):
    e = read(spark, sf, "events")
    return e.filter("event_type = 'view'").select("user_id").distinct().join(e.filter("event_type = 'purchase' AND value > 50").select("user_id"), "user_id", "left_anti")


@query("SET01 SET10 RUL06", "SELECT s_nationkey::BIGINT AS nation FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def endpoint_union(spark, sf):
    a, b = read(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("nation")), read(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").cast("long").alias("nation"))
    return a.union(b).distinct()


@query("SET02 JOI14", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def endpoint_intersection(spark, sf):
    return read(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey").intersect(read(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("SET09", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY 1, 2)
SELECT user_id, e AS event_id, count(*) OVER (PARTITION BY user_id ORDER BY e) AS watched FROM f""")
def watch_set_growth(spark, sf):
    from pyspark.sql import Window

    f = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return f.select("user_id", "event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("event_id")).alias("watched"))


@query("INC18", """
WITH l AS (SELECT user_id, event_id, event_type, value < 5 AS failed, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS resolve FROM events)
SELECT event_id, resolve, coalesce(bool_or(failed) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS poisoned FROM l""")
def fingerprint_windows(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    own = Window.partitionBy("user_id", "event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = read(spark, sf, "events").withColumn("resolve", ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)))
    return e.select("event_id", "resolve", F.coalesce(F.bool_or(F.col("value") < 5).over(own), F.lit(False)).alias("poisoned"))


@query("INC17 JOI10", """
SELECT event_type || '::' || CAST(user_id % 10 AS VARCHAR) AS scope_key, count(DISTINCT user_id) AS claimants, min(event_id) AS first_seen, count(DISTINCT user_id) > 1 AS ambiguous FROM events GROUP BY 1""")
def scope_claimants(spark, sf):
    key = F.concat_ws("::", "event_type", F.pmod("user_id", F.lit(10)).cast("string"))
    return read(spark, sf, "events").groupBy(key.alias("scope_key")).agg(F.count_distinct("user_id").alias("claimants"), F.min("event_id").alias("first_seen"), (F.count_distinct("user_id") > 1).alias("ambiguous"))

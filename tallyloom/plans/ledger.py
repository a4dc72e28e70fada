"""Ledger queries: upserts, work lists, carry-forward, caches, incremental guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..sources.tables import read
from .registry import query

R = lambda c, n=6: F.round(c, n)


@query("SNK04 SNK05 INC19", """
WITH t AS (SELECT doc_id AS k, quality AS v, doc_id % 100 AS "at", 0 AS f FROM labels UNION ALL SELECT doc_id, n_chars % 7, doc_id % 90, 1 FROM documents WHERE doc_id % 3 = 0)
SELECT k, v::BIGINT AS v, "at" FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY "at" DESC, f DESC) AS r FROM t) WHERE r = 1""")
def ledger_upsert(spark, sf):
    t = read(spark, sf, "labels").select(F.col("doc_id").alias("k"), F.col("quality").cast("long").alias("v"), F.pmod("doc_id", F.lit(100)).alias("at"))
    fresh = read(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("k"), F.pmod("n_chars", F.lit(7)).cast("long").alias("v"), F.pmod("doc_id", F.lit(90)).alias("at"))
    return joins.upsert(t, fresh, ["k"], [F.desc("at")])


@query("JOI19 JOI22 INC01 INC12 FLT24", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def work_list(spark, sf):
    return joins.work_list(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").filter("toxic = 0"), ["doc_id"])


@query("SNK13 INC02 INC21 SET10", """
WITH fresh AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' AND n_chars > 1000 AND CAST(substr(source, 4) AS INT) < 8 GROUP BY 1), old AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE source NOT IN (SELECT source FROM fresh)""")
def carry_forward(spark, sf):
    d = read(spark, sf, "documents")
    fresh = d.filter("lang = 'fr' AND n_chars > 1000").filter(F.substring("source", 4, 9).cast("int") < 8).groupBy("source").agg(F.count("*").alias("n"))
    return joins.carry_forward(d.groupBy("source").agg(F.count("*").alias("n")), fresh, "source")


@query("JOI10 JOI23 INC22 JOI31", """
WITH u AS (SELECT s_nationkey AS k, 'supplier' AS origin, count(*) AS n, 0 AS f FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, 'customer', count(*), 1 FROM customer GROUP BY 1 UNION ALL SELECT n_nationkey, 'nation', 1, 2 FROM nation)
SELECT k::BIGINT AS k, origin, n, f::BIGINT AS source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f) AS r FROM u) WHERE r = 1""")
def precedence_merge(spark, sf):
    s = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.lit("supplier").alias("origin"), F.count("*").alias("n"))
    c = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.lit("customer").alias("origin"), F.count("*").alias("n"))
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("origin"), F.lit(1).cast("long").alias("n"))
    return joins.precedence_merge([s, c, n], ["k"]).select(F.col("k").cast("long").alias("k"), "origin", "n", F.col("source").cast("long").alias("source"))


@query("JOI11", """
WITH m AS (SELECT doc_id, quality::BIGINT AS v FROM labels), c AS (SELECT doc_id, n_chars % 2 AS v FROM documents)
SELECT c.doc_id, coalesce(m.v, c.v) AS v, CASE WHEN m.doc_id IS NULL THEN 'checkpoint' ELSE 'manifest' END AS origin FROM c LEFT JOIN m USING (doc_id)""")
def manifest_wins(spark, sf):
    m = read(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("m"), F.lit(True).alias("has"))
    c = read(spark, sf, "documents").select("doc_id", F.pmod("n_chars", F.lit(2)).alias("c"))
    return c.join(m, "doc_id", "left").select("doc_id", F.coalesce("m", "c").alias("v"), F.when(F.col("has").isNull(), "checkpoint").otherwise("manifest").alias("origin"))


@query("INC05", """
WITH cache AS (SELECT doc_id AS id, n_chars AS size, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'now' END AS stamp FROM documents WHERE doc_id % 5 <> 0)
SELECT d.doc_id, c.id IS NOT NULL AS hit FROM documents d LEFT JOIN cache c ON c.id = d.doc_id AND c.size = d.n_chars AND c.stamp = 'now'""")
def verdict_cache(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars")
    stamp = F.when(F.pmod("doc_id", F.lit(4)) == 0, "old").otherwise("now")
    cache = d.filter("doc_id % 5 <> 0").withColumn("stamp", stamp).filter("stamp = 'now'").select("doc_id", "n_chars", F.lit(True).alias("h"))
    return d.join(cache, ["doc_id", "n_chars"], "left").select("doc_id", F.col("h").isNotNull().alias("hit"))


@query("SET08 RUL10", """
SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS ok, count(*) FILTER (d.doc_id IS NULL) AS vanished, count(*) FILTER (l.doc_id IS NULL) AS unlisted FROM (SELECT doc_id FROM labels) l FULL JOIN (SELECT doc_id FROM documents) d USING (doc_id)""")
def vanished(spark, sf):
    l = read(spark, sf, "labels").select("doc_id", F.lit(1).alias("l"))  # noqa: E741
    j = l.join(read(spark, sf, "documents").select("doc_id", F.lit(1).alias("d")), "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("l").isNotNull() & F.col("d").isNotNull()).alias("ok"), F.count_if(F.col("d").isNull()).alias("vanished"), F.count_if(F.col("l").isNull()).alias("unlisted"))


@query("INC23", "SELECT row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, s_suppkey AS id, s_nationkey::BIGINT AS project FROM supplier")
def narrow_manifest(spark, sf):
    from pyspark.sql import Window

    return read(spark, sf, "supplier").select(F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long").alias("n"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("project"))


@query("INC24", "SELECT count(*) AS identities, count(*) = 1 AS single FROM (SELECT DISTINCT r_regionkey FROM region WHERE r_name = 'ASIA')")
def single_identity(spark, sf):
    ids = read(spark, sf, "region").filter("r_name = 'ASIA'").select("r_regionkey").distinct()
    return ids.agg(F.count("*").alias("identities"), (F.count("*") == 1).alias("single"))


@query("INC20", """
WITH o AS (SELECT user_id % 20 AS gid, event_type AS binding, max(event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), f AS (SELECT user_id % 20 AS gid, event_type AS binding, max(event_id) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT gid, string_agg(binding || '=' || v, ',' ORDER BY binding) AS bindings FROM (SELECT gid, binding, coalesce(f.v, o.v) AS v FROM o FULL JOIN f USING (gid, binding)) GROUP BY 1""")
def nested_map_merge(spark, sf):
    """Even events are the old side, odd ones the fresh side: each event of each group is in one."""
    e = read(spark, sf, "events").select(F.pmod("user_id", F.lit(20)).alias("gid"), F.col("event_type").alias("binding"), "event_id")
    even = F.pmod("event_id", F.lit(2)) == 0
    return _merged(e.filter(even), e.filter(~even))


def _merged(old, fresh):
    o = old.groupBy("gid", "binding").agg(F.max("event_id").alias("o"))
    f = fresh.groupBy("gid", "binding").agg(F.max("event_id").alias("f"))
    m = o.join(f, ["gid", "binding"], "full_outer").select("gid", F.concat_ws("=", "binding", F.coalesce("f", "o").cast("string")).alias("b"))
    return m.groupBy("gid").agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias("bindings"))


@query("INC27", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'measured' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'warn' ELSE 'free' END AS guard FROM customer")
def measurement_guard(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("done"))
    return read(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.when(F.col("done"), "measured").when(F.col("done").isNotNull(), "warn").otherwise("free").alias("guard"))


@query("INC13", "SELECT user_id, event_type, CASE WHEN count(*) >= 15 THEN 'skip' WHEN count(*) >= 10 THEN 'redo' ELSE 'drop' END AS action FROM events GROUP BY 1, 2")
def resume_actions(spark, sf):
    n = F.count("*")
    return read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.when(n >= 15, "skip").when(n >= 10, "redo").otherwise("drop").alias("action"))


@query("ext row counts", "SELECT 'orders' AS name, count(*) AS rows, count(*) = count(DISTINCT o_orderkey) AS unique_key, count(*) FILTER (o_orderkey IS NULL) AS nulls FROM orders")
def rebuild_gate(spark, sf):
    return read(spark, sf, "orders").agg(F.lit("orders").alias("name"), F.count("*").alias("rows"), (F.count("*") == F.count_distinct("o_orderkey")).alias("unique_key"), F.count_if(F.col("o_orderkey").isNull()).alias("nulls")).select("name", "rows", "unique_key", "nulls")


@query("JOI25 JOI30", "SELECT n_nationkey::BIGINT AS wanted, CASE WHEN s IS NULL THEN 'not produced' ELSE 'ok' END AS reason FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier WHERE s_acctbal > 5000) ON s = n_nationkey")
def missing_with_reason(spark, sf):
    s = read(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(1).alias("s")).distinct()
    return read(spark, sf, "nation").select("n_nationkey").join(s, "n_nationkey", "left").select(F.col("n_nationkey").cast("long").alias("wanted"), F.when(F.col("s").isNull(), "not produced").otherwise("ok").alias("reason"))


@query("JOI02 AGG06", "SELECT o_custkey, count(*) AS n, round(median(o_totalprice), 4) AS median, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY 1")
def medians_by_role(spark, sf):
    g = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), R(F.median("o_totalprice"), 4).alias("median"), F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return g.select("o_custkey", "n", "median", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("keys"))


@query("WIN03", "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def trusted_next(spark, sf):
    from pyspark.sql import Window

    good = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    o = read(spark, sf, "orders").join(good, "o_custkey", "left_semi")
    return o.select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next"))


@query("SRT08 FLT07", "SELECT p_partkey, p_brand FROM part WHERE p_size >= 20 AND p_retailprice >= 1000 AND p_type IS NOT NULL")
def thresholds(spark, sf):
    return read(spark, sf, "part").filter("p_size >= 20 AND p_retailprice >= 1000 AND p_type IS NOT NULL").select("p_partkey", "p_brand").sortWithinPartitions("p_brand", "p_partkey")


@query("SRT05", "SELECT s_suppkey, md5('7:' || s_suppkey) AS at FROM supplier")
def seeded_order(spark, sf):
    """[SRT05] Work in an order fixed by a seed: by hash, so it needs no shuffle of its own beyond the sort."""
    return read(spark, sf, "supplier").select("s_suppkey", F.md5(F.concat(F.lit("7:"), F.col("s_suppkey").cast("string"))).alias("at")).orderBy("at", "s_suppkey")


@query("FLT12 JOI20", """
SELECT d.source, min(d.doc_id) AS first_doc FROM documents d WHERE d.source NOT IN ('src1', 'src2') AND d.doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1""")
def unseen_candidates(spark, sf):
    d = read(spark, sf, "documents").filter(~F.col("source").isin("src1", "src2")).select("source", "doc_id")
    return joins.work_list(d, read(spark, sf, "labels"), ["doc_id"]).groupBy("source").agg(F.min("doc_id").alias("first_doc"))


@query("FLT14", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'absent' WHEN l.quality <> 1 THEN 'unresolved' ELSE 'extracted' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def closure_status(spark, sf):
    l = read(spark, sf, "labels").select("doc_id", "quality", F.lit(1).alias("h"))  # noqa: E741
    return read(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.when(F.col("h").isNull(), "absent").when(F.col("quality") != 1, "unresolved").otherwise("extracted").alias("status"))

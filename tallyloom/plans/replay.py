"""Journals, caches and peeling: events as a journal, documents as cached roles, orders as roles of their customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay
from ..sources.tables import read
from .registry import query

_JOURNAL = """
e AS (SELECT user_id AS repo, event_id AS seq, CASE WHEN event_id % 29 = 0 THEN 'header' WHEN event_id % 13 = 0 THEN 'scope' ELSE 'commit' END AS kind, event_id % 3 > 0 AS fits, 'c' || event_id % 500 AS commit,
  CASE WHEN event_type = 'error' THEN 'checkout_failed' WHEN value < 10 THEN 'pubspec_unresolved' ELSE 'walked' END AS outcome, event_id % 3 = 0 AS resolved FROM events),
h AS (SELECT *, last_value(CASE WHEN kind = 'header' THEN fits END IGNORE NULLS) OVER (PARTITION BY repo ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS force FROM e),
j AS (SELECT * FROM h WHERE kind <> 'header' AND force),
c AS (SELECT j.*, i, 'r' || (seq + i) % 7 AS id, 'd' || seq || '-' || i AS digest, (seq + i) % 4 > 0 AS isolated, (seq + i) % 5 > 0 AS clean FROM j, (VALUES (0), (1)) v(i) WHERE kind = 'commit' AND outcome = 'walked')"""


def _journal(spark, sf):
    k = F.col("event_id")
    row = lambda i: F.struct(F.concat(F.lit("r"), ((k + i) % 7).cast("string")).alias("id"), F.concat(F.lit("d"), k.cast("string"), F.lit(f"-{i}")).alias("digest"), F.when((k + i) % 4 > 0, "isolated").otherwise("kept").alias("status"), ((k + i) % 5 > 0).alias("clean"))
    return read(spark, sf, "events").select(
        F.col("user_id").alias("repo"),
        k.alias("seq"),
        F.when(k % 29 == 0, "header").when(k % 13 == 0, "scope").otherwise("commit").alias("kind"),
        (k % 3 > 0).alias("fits"),
        F.concat(F.lit("c"), (k % 500).cast("string")).alias("commit"),
        F.when(F.col("event_type") == "error", "checkout_failed").when(F.col("value") < 10, "pubspec_unresolved").otherwise("walked").alias("outcome"),
        (k % 3 == 0).alias("resolved"),
        F.array(row(0), row(1)).alias("rows"),
        F.when(k % 10 == 1, F.array(k)).otherwise(F.array().cast("array<long>")).alias("new_groups"),
    )


@query("INC03", f"""
WITH {_JOURNAL},
a AS (SELECT repo, count(DISTINCT CASE WHEN kind = 'commit' THEN commit END) AS walked, arg_max(commit, seq) FILTER (kind = 'commit') AS resumed_from, count(*) FILTER (kind = 'commit' AND resolved) AS resolutions, count(*) FILTER (kind = 'commit' AND outcome = 'checkout_failed') AS checkout_failed,
  count(*) FILTER (kind = 'commit' AND outcome = 'pubspec_unresolved') AS unresolved, count(*) FILTER (kind = 'commit' AND outcome = 'walked' AND seq % 10 = 1) AS minted FROM j GROUP BY 1),
b AS (SELECT repo, count(*) AS code_rows, count(*) FILTER (isolated) AS transplanted, count(*) FILTER (isolated AND clean) AS transplanted_clean FROM c GROUP BY 1)
SELECT a.repo, walked, resumed_from, resolutions, checkout_failed, unresolved, coalesce(code_rows, 0) AS code_rows, coalesce(transplanted, 0) AS transplanted, coalesce(transplanted_clean, 0) AS transplanted_clean, minted FROM a LEFT JOIN b ON a.repo = b.repo""")
def journal_counters(spark, sf):
    """What is known of a repository when its walk is taken up again; entries behind a header of another mode are void."""
    return replay.replay(replay.in_force(_journal(spark, sf), "repo", "seq", "kind", "fits"), "repo", "seq")


@query("INC03", f"WITH {_JOURNAL} SELECT repo, id, arg_max(digest, seq * 2 + i) AS digest FROM c GROUP BY 1, 2")
def journal_digests(spark, sf):
    """The digest that the next revision of each row has to differ from."""
    return replay.last_digests(replay.in_force(_journal(spark, sf), "repo", "seq", "kind", "fits"), "repo", "seq")


@query("INC07", """
WITH s AS (SELECT c_custkey, '{"backend":"' || lower(c_mktsegment) || '","fixtures":{"images":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"values":[' || c_nationkey || ',"' || c_nationkey || '"]},"level":' || CASE WHEN c_custkey % 7 = 0 THEN '"1"' ELSE '1' END || ',"strict":null}' AS canon FROM customer)
SELECT sha256(canon) AS mode, count(*) AS checkpoints, count(*) FILTER (sha256(canon) = sha256('{"backend":"building","fixtures":{"images":true,"values":[3,"3"]},"level":1,"strict":null}')) AS reused FROM s GROUP BY 1""")
def mode_fingerprints(spark, sf):
    """Settings of every customer's checkpoint, written with keys in three orders; those of one mode are taken up again."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    backend = F.concat(F.lit('"backend": "'), F.lower("c_mktsegment"), F.lit('"'))
    images = F.concat(F.lit('"images":'), F.when(k % 2 == 0, "true").otherwise("false"))
    values = F.concat(F.lit('"values" : ['), n, F.lit(', "'), n, F.lit('"]'))
    fixtures = F.concat(F.lit('"fixtures":{'), F.when(k % 3 == 1, F.concat(values, F.lit(","), images)).otherwise(F.concat(images, F.lit(" , "), values)), F.lit("}"))
    level = F.concat(F.lit('"level": '), F.when(k % 7 == 0, '"1"').otherwise("1"))
    strict = F.lit('"strict": null')
    text = F.when(k % 3 == 0, F.concat_ws(",", strict, level, fixtures, backend)).when(k % 3 == 1, F.concat_ws(", ", fixtures, strict, backend, level)).otherwise(F.concat_ws(",\n", backend, fixtures, level, strict))
    own = read(spark, sf, "customer").select(replay.fingerprint(F.concat(F.lit("{"), text, F.lit("}"))).alias("mode"))
    now = replay.fingerprint(F.lit('{"level":1,"strict":null,"fixtures":{"values":[3,"3"],"images":true},"backend":"building"}'))
    return replay.reusable(own, now, "mode").groupBy("mode").agg(F.count("*").alias("checkpoints"), F.count_if("reuse").alias("reused"))


@query("INC06", """
WITH r AS (SELECT doc_id, source, sha256(text || chr(0) || sha256(source)) AS key, n_chars FROM documents),
k AS (SELECT key, max(CASE WHEN n_chars >= 800 THEN n_chars END) AS answer FROM r WHERE doc_id % 3 > 0 GROUP BY 1)
SELECT source, count(*) AS offered, count(*) FILTER (k.key IS NOT NULL AND answer IS NOT NULL) AS hits, count(*) FILTER (k.key IS NOT NULL AND answer IS NULL) AS negatives, count(*) FILTER (k.key IS NULL) AS misses, count(DISTINCT CASE WHEN k.key IS NULL THEN r.key END) AS analysed,
  count(*) FILTER (coalesce(answer, CASE WHEN k.key IS NULL AND n_chars >= 800 THEN n_chars END) IS NOT NULL) AS with_vector FROM r LEFT JOIN k ON k.key = r.key GROUP BY 1""")
def cached_vectors(spark, sf):
    """Roles by content and fixture: two thirds were analysed before, short ones to no vector; a second look finds every key."""
    d = read(spark, sf, "documents")
    roles = d.select("doc_id", "source", "n_chars", F.sha2(F.concat("text", F.lit("\0"), F.sha2("source", 256)), 256).alias("key"))
    vector = F.when(F.col("n_chars") >= 800, F.col("n_chars"))
    cache = replay.remember(roles.filter("false").select("key", vector.alias("answer")), roles.filter("doc_id % 3 > 0").select("key", vector.alias("answer")), "key", "answer")
    first = replay.cached(roles, cache, "key", "answer")
    full = replay.remember(cache, first.filter("state = 'miss'").select("key", vector.alias("answer")), "key", "answer")
    again = first.select("source", "key", "state").join(full.withColumnRenamed("answer", "vector"), "key", "left")
    of = lambda s: F.count_if(F.col("state") == s)
    return again.groupBy("source").agg(F.count("*").alias("offered"), of("hit").alias("hits"), of("negative").alias("negatives"), of("miss").alias("misses"), F.count_distinct(F.when(F.col("state") == "miss", F.col("key"))).alias("analysed"), F.count("vector").alias("with_vector"))


#: Rounds written out in SQL; one more than are needed changes nothing.
SQL_ROUNDS = 12


def _peel_sql() -> str:
    out = ["r0 AS (SELECT o_custkey AS g, o_orderkey AS role, o_custkey % 13 = 0 AS awaiting, CASE WHEN o_orderkey % 5 = 0 OR o_custkey % 17 = 0 THEN 0 END AS dropped FROM orders), p AS (SELECT o_orderkey AS a, o_orderkey + 1 + o_orderkey % 2 AS b FROM orders WHERE o_orderstatus <> 'P')"]
    for k in range(1, SQL_ROUNDS + 1):
        was = f"r{k - 1}"
        out.append(f"""e{k} AS MATERIALIZED (SELECT DISTINCT unnest([a, b]) AS role FROM p WHERE a IN (SELECT role FROM {was} WHERE dropped IS NULL) AND b IN (SELECT role FROM {was} WHERE dropped IS NULL)),
s{k} AS MATERIALIZED (SELECT {was}.*, e{k}.role IS NOT NULL AS ends, dropped IS NULL AND (e{k}.role IS NOT NULL OR awaiting) AS kept FROM {was} LEFT JOIN e{k} ON e{k}.role = {was}.role),
r{k} AS MATERIALIZED (SELECT s{k}.g, role, awaiting, CASE WHEN dropped IS NULL AND NOT (kept AND stands) THEN {k} ELSE dropped END AS dropped FROM s{k} JOIN (SELECT g, count(*) FILTER (kept) >= 2 AND count(*) FILTER (kept AND ends) > 0 AS stands FROM s{k} GROUP BY 1) t ON t.g = s{k}.g)""")
    return f"WITH {', '.join(out)} SELECT g AS \"group\", role, dropped FROM r{SQL_ROUNDS}"


@query("RUL09 INC09", _peel_sql())
def shipped_roles(spark, sf):
    """Orders as roles of their customers, compared in pairs across customers; screening repeats until nothing falls."""
    o = read(spark, sf, "orders")
    k, g = F.col("o_orderkey"), F.col("o_custkey")
    roles = o.select(g.alias("group"), k.alias("role"), (k % 5 == 0).alias("hard"))
    pairs = o.select(k.alias("left"), (k + 1 + k % 2).alias("right"), (F.col("o_orderstatus") != "P").alias("eligible"))
    groups = o.select(g.alias("group")).distinct().select("group", (F.col("group") % 17 == 0).alias("held"), (F.col("group") % 13 == 0).alias("awaiting"))
    return replay.peel(roles, pairs, groups)

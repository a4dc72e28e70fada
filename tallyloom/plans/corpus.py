"""Unions of declarations, imports, audits of mutations, and what may enter or leave a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, spans, unions
from ..sources.tables import events, read
from .registry import query


@query("RUL16 SET06")
def fixture_union(spark, sf):
    """Users as roles of a type, their events as declarations; few differ in form. Roles are settled in rounds."""
    k, name = F.col("event_id"), F.concat(F.lit("n"), (F.col("event_id") % 97).cast("string"))
    text = F.concat(F.lit("final "), name, F.lit(" = "), F.when(k % 41 == 0, "2;").otherwise("1;"))
    declared = read(spark, sf, "events").select(F.col("event_type").alias("grp"), F.lpad(F.col("user_id").cast("string"), 9, "0").alias("role"), k.alias("at"), name.alias("name"), F.when(k % 97 < 20, F.concat(F.lit("class "), name)).alias("header"), text.alias("text"), F.when(k % 11 == 0, "lifted").otherwise("seed").alias("section"), (k % 5 == 0).alias("needs_value"))
    return unions.accepted_roles(declared, "grp", "role")


@query("RUL26", """
WITH i AS (SELECT user_id AS file, 'package:p' || event_id % 23 AS uri, event_id AS place, CASE WHEN event_id % 13 = 0 THEN 'show' WHEN event_id % 17 = 0 THEN 'hide' WHEN event_id % 19 = 0 THEN 'as' ELSE 'plain' END AS how FROM events WHERE event_id % 3 = 0),
x AS (SELECT DISTINCT 'package:p' || s_suppkey % 21 AS uri, s_nationkey AS name FROM supplier), z AS (SELECT uri, count(*) AS size FROM x GROUP BY 1), u AS (SELECT DISTINCT user_id AS file, CAST(floor(value) AS BIGINT) % 40 AS name FROM events),
r AS (SELECT i.*, size FROM i LEFT JOIN z ON z.uri = i.uri), g AS (SELECT r.file, r.uri, r.place, u.name, row_number() OVER (PARTITION BY r.file, u.name ORDER BY how = 'plain', CASE WHEN how = 'plain' THEN -size ELSE 0 END, place) AS k
  FROM r JOIN x ON x.uri = r.uri JOIN u ON u.file = r.file AND u.name = x.name WHERE how = 'plain' OR how = 'show' AND u.name IN (3, 7) OR how = 'hide' AND u.name NOT IN (3, 7)),
n AS (SELECT DISTINCT file, uri, place FROM g WHERE k = 1)
SELECT r.file, r.uri, r.place AS "at", CASE WHEN size IS NULL THEN 'unknown' WHEN how <> 'plain' THEN 'fixed' WHEN n.place IS NULL THEN 'drop' ELSE 'keep' END AS action FROM r LEFT JOIN n ON n.file = r.file AND n.uri = r.uri AND n.place = r.place""")
def import_cover(spark, sf):
    """Imports of every user's file: widest first, shown and hidden names, packages without an export table."""
    e, k = read(spark, sf, "events"), F.col("event_id")
    uri = lambda c: F.concat(F.lit("package:p"), c.cast("string"))
    how = F.when(k % 13 == 0, "show").when(k % 17 == 0, "hide").when(k % 19 == 0, "as").otherwise("plain")
    imports = e.filter(k % 3 == 0).select(F.col("user_id").alias("file"), uri(k % 23).alias("uri"), k.alias("at"), how.alias("how"), F.array(F.lit("3"), F.lit("7")).alias("names"))
    exports = read(spark, sf, "supplier").select(uri(F.col("s_suppkey") % 21).alias("uri"), F.col("s_nationkey").cast("string").alias("name")).distinct()
    used = e.select(F.col("user_id").alias("file"), (F.floor("value") % 40).cast("string").alias("name")).filter("name IS NOT NULL")
    return unions.kept_imports(imports, used, exports)


_DELTAS = {"depth": "o_orderkey % 3 - 1", "size": "o_custkey % 4 - 1", "loops": "CAST(o_orderkey % 7 = 0 AS BIGINT)"}
_AUDIT = f"""
WITH p AS (SELECT o_orderkey AS pair, o_orderpriority AS directive, CASE o_orderstatus WHEN 'F' THEN 'slower' WHEN 'O' THEN 'faster' END AS expect, o_custkey % 2 AS label, {", ".join(f"{c} AS {n}" for n, c in _DELTAS.items())} FROM orders),
n AS (SELECT pair, list_filter([
  CASE WHEN expect = 'slower' AND label = 0 OR expect = 'faster' AND label = 1 THEN 'label disagreement' END,
  CASE WHEN depth <> 0 AND directive NOT IN ('1-URGENT', '3-MEDIUM') THEN 'tangled depth' END,
  CASE WHEN loops <> 0 AND directive <> '2-HIGH' THEN 'tangled loops' END,
  CASE WHEN size <> 0 AND directive NOT IN ('1-URGENT', '2-HIGH') THEN 'tangled size' END,
  CASE WHEN directive NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'unknown directive' END,
  CASE WHEN directive = '1-URGENT' AND depth <= 0 THEN 'weak depth' WHEN directive = '3-MEDIUM' AND depth >= 0 THEN 'weak depth' END,
  CASE WHEN directive = '2-HIGH' AND size <= 0 THEN 'weak size' END], lambda x: x IS NOT NULL) AS notes FROM p)"""


@query("RUL13 AGG23", _AUDIT + " SELECT array_to_string(notes, '; ') AS notes, count(*) AS pairs FROM n GROUP BY 1")
def mutation_audit(spark, sf):
    """Every order as a mutation of its priority's directive: expected and tolerated features, tangled changes, labels."""
    o = read(spark, sf, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "slower").when(F.col("o_orderstatus") == "O", "faster")
    pairs = o.select(F.col("o_orderkey").alias("pair"), F.col("o_orderpriority").alias("directive"), label.alias("expect"), (F.col("o_custkey") % 2).alias("label"))
    deltas = o.select(F.col("o_orderkey").alias("pair"), F.expr(f"stack({len(_DELTAS)}, {', '.join(f'{n!r}, {c}' for n, c in _DELTAS.items())}) AS (feature, delta)"))
    expected = spark.createDataFrame([("1-URGENT", "depth", 1), ("2-HIGH", "size", 1), ("3-MEDIUM", "depth", -1)], "directive string, feature string, sign int")
    tolerated = spark.createDataFrame([("1-URGENT", "size"), ("2-HIGH", "loops")], "directive string, feature string")
    found = unions.audited(pairs, deltas, expected, tolerated)
    return found.groupBy(F.array_join("notes", "; ").alias("notes")).agg(F.count("*").alias("pairs"))


@query("FLT20", f"""
WITH p AS (SELECT o_custkey AS scope, {", ".join(f"{c} AS {n}" for n, c in _DELTAS.items())}, CAST(o_orderkey % 41 = 0 AS BIGINT) AS rare, CAST(o_custkey = 7 AS BIGINT) AS lone FROM orders),
l AS (SELECT scope, unnest(['depth', 'size', 'loops', 'rare', 'lone']) AS feature, unnest([depth, size, loops, rare, lone]) AS delta FROM p)
SELECT feature, count(*) AS pairs, count(*) FILTER (delta <> 0) AS moved, count(DISTINCT CASE WHEN delta <> 0 THEN scope END) AS scopes FROM l GROUP BY 1 HAVING count(*) FILTER (delta <> 0) >= 0.05 * count(*) AND count(DISTINCT CASE WHEN delta <> 0 THEN scope END) >= 3""")
def selected_features(spark, sf):
    """Features that move in a twentieth of the pairs and in three scopes; one that moves too rarely and one in a single scope go."""
    columns = _DELTAS | {"rare": "CAST(o_orderkey % 41 = 0 AS BIGINT)", "lone": "CAST(o_custkey = 7 AS BIGINT)"}
    long = read(spark, sf, "orders").select(F.col("o_custkey").alias("scope"), F.expr(f"stack({len(columns)}, {', '.join(f'{n!r}, {c}' for n, c in columns.items())}) AS (feature, delta)"))
    return corpus.moving(long, "scope", "feature", "delta")


@query("SRC26", """
SELECT c_custkey FROM customer WHERE c_custkey % 50 NOT IN (SELECT s_suppkey % 50 FROM supplier WHERE s_nationkey = 3) AND c_custkey % 50 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def eligible_candidates(spark, sf):
    """Customers as harvested repositories, less the corpus's and the standing list, however their addresses are spelled."""
    at = lambda c, head: F.concat(F.lit(head), (c % 50).cast("string"))
    found = read(spark, sf, "customer").select("c_custkey", at(F.col("c_custkey"), "https://host.example/Owner/App").alias("url"))
    own = read(spark, sf, "supplier").filter("s_nationkey = 3").select(at(F.col("s_suppkey"), "owner/app").alias("url"))
    listed = read(spark, sf, "nation").filter("n_regionkey = 1").select(at(F.col("n_nationkey").cast("long"), " OWNER/APP").alias("url"))
    return corpus.eligible(found, [own, listed], "url", T.repo_key).select("c_custkey")


@query("RUL19", """
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN 'restored' ELSE 'authored' END WHEN doc_id % 5 = 0 THEN 'written' WHEN doc_id % 7 = 0 THEN 'authored' WHEN doc_id % 3 = 0 THEN 'written' ELSE 'current' END AS action FROM documents""")
def placements(spark, sf):
    """Every document as a generated file: kept by the store, edited since, unchanged, outdated or missing."""
    k, new = F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)
    present = F.when(k % 5 != 0, F.when(k % 7 == 0, F.lit("edited")).when(k % 3 == 0, F.lit("older")).otherwise(new))
    recorded = F.when(k % 3 == 0, F.lit("older")).otherwise(new)
    action = corpus.placement(k % 11 == 0, k % 2 == 0, k % 3 > 0, present, recorded, new)
    return read(spark, sf, "documents").select("doc_id", action.alias("action"))


@query("RUL10", """
WITH g AS (SELECT DISTINCT o_custkey AS "group" FROM orders), own AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 4 = 0 AND o_orderpriority LIKE '1%')
SELECT "group", CASE WHEN "group" IN (SELECT o_custkey FROM own) THEN 'protect' ELSE 'remove' END AS action FROM g WHERE "group" % 3 > 0 AND "group" % 5 > 0""")
def stale_groups(spark, sf):
    """Customers as exported groups: a third is eligible, a fifth held; of the rest those with a file of their own stay."""
    o = read(spark, sf, "orders")
    files = o.select(F.col("o_custkey").alias("group"), F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))).otherwise("fixture").alias("name"), "o_orderkey")
    groups = files.select("group").distinct()
    return corpus.stale(groups, groups.filter("group % 3 = 0"), groups.filter("group % 5 = 0"), files, files.filter("o_orderkey % 4 > 0"), ["fixture"])


@query("RUL11", """
WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END DESC, event_type DESC) AS r FROM events WHERE user_id % 3 > 0),
t AS (SELECT DISTINCT user_id, 'known' AS verdict FROM events WHERE user_id % 2 = 0)
SELECT user_id, event_type AS verdict FROM f WHERE r = 1 UNION ALL SELECT user_id, verdict FROM t WHERE user_id % 3 = 0""")
def observed_verdicts(spark, sf):
    """A survey of two thirds of the keys on several devices laid over what was known."""
    e = read(spark, sf, "events")
    table = e.filter("user_id % 2 = 0").select("user_id").distinct().withColumn("verdict", F.lit("known"))
    fresh = e.filter("user_id % 3 > 0").select("user_id", F.col("event_type").alias("verdict"))
    rank = F.when(F.col("verdict") == "error", 2).when(F.col("verdict") == "view", 1).otherwise(0)
    return corpus.observed(table, fresh, ["user_id"], rank, ["verdict"])


@query("SRT07", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, coalesce(sum(CAST(value > 50 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM events) WHERE n < 5""")
def stopped_after(spark, sf):
    """Each user's events in time until five were accepted."""
    return corpus.until_accepted(events(spark, sf), ["user_id"], ["us", "event_id"], F.col("value") > 50, 5).select("user_id", "event_id")


@query("INC30", """
SELECT count(*) AS "groups", CAST(sum(n) AS BIGINT) AS roles FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def pruned_corpus(spark, sf):
    """A stamp of every customer's roles, the same for the rows in another order; a tool that needs every role refuses it."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").cast("string").alias("role"))
    stamp = corpus.prune_stamp(o, "values", "rules")
    again = corpus.prune_stamp(o.repartition(7, "role"), "values", "rules")
    same = stamp.alias("a").join(again.alias("b"), "roles").select(F.col("a.groups").alias("groups"))
    try:
        corpus.refuse_pruned(stamp, "fill")
    except ValueError:
        return same.crossJoin(F.broadcast(o.agg(F.count("*").alias("roles"))))
    raise AssertionError("a pruned corpus was not refused")


_GATE = {"forbidden await": "k % 23 = 0", "imports changed": "k % 19 = 0", "fields changed": "k % 17 = 0", "start changed": "k % 13 = 0", "stop changed": "k % 11 = 0"}


@query("RUL12", f"""
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS id, array_to_string(list_filter([{", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w in _GATE.items())}, CASE WHEN k % 7 = 0 AND {" AND ".join(f"NOT ({w})" for w in _GATE.values())} AND k % 29 > 0 THEN 'no change' END,
  CASE WHEN k % 29 = 0 THEN 'texts +new' || k || ' -old' || k END, CASE WHEN k % 31 = 0 THEN 'not compiled' END], lambda v: v IS NOT NULL), '; ') AS violations FROM c""")
def mutation_gate(spark, sf):
    """Every customer's source and its mutation: imports, fields and lifecycle bodies cut out of both texts and compared, texts shown, constructs outside strings."""
    k = F.col("c_custkey")
    on = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    id_ = k.cast("string")

    def source(start, stop, field, imports, shown, tree, extra):
        return F.concat(F.lit("import 'a.dart';\n"), imports, F.lit("class _S extends State<A> {\n  final n = 1; // {\n"), field, F.lit("  @override\n  void initState() { if (a) { "), start, F.lit(" } }\n  void dispose() { "), stop, F.lit(" }\n  Widget build(c) { return "), tree, F.lit("(Text('await "), id_, F.lit("'), Text('"), shown, id_, F.lit("')); }\n"), extra, F.lit("}"))

    base = source(F.lit("x();"), F.lit("y();"), F.lit("  int q = 2;\n"), F.lit(""), F.lit("old"), F.lit("Row"), F.lit(""))
    made = source(on(13, "x(1);", "x();"), on(11, "", "y();"), on(17, "  int q = 3;\n", "  int   q = 2;\n"), on(19, "import 'b.dart';\n", ""), on(29, "new", "old"), on(7, "Row", "Column"), on(23, "  f() async { await g(); }\n", ""))
    own = read(spark, sf, "customer").select(k.alias("id"), base.alias("base"), made.alias("made"), (k % 31 > 0).alias("compiled"))
    for side in ("base", "made"):
        own = own.withColumn(f"{side}_imports", F.array_join(F.array_sort(F.regexp_extract_all(side, F.lit(r"(?m)^(import\s+'[^']+';)"), F.lit(1))), "|"))
        own = own.withColumn(f"{side}_texts", F.regexp_extract_all(side, F.lit(r"Text\('([^']*)'\)"), F.lit(1)))
        own = own.withColumn(f"{side}_fields", F.regexp_extract(side, r"class _S[^{]*\{([\s\S]*?)@override", 1))
        for part, mark in (("start", r"\binitState\s*\([^)]*\)"), ("stop", r"\bdispose\s*\([^)]*\)")):
            own = spans.brace_block(own, "id", side, mark, strings=True).withColumnRenamed("block", f"{side}_{part}")
    found = corpus.gate(own, {"await": r"\bawait\b"}, ["imports", "fields", "start", "stop"], ["compiled"])
    return found.select("id", F.array_join("violations", "; ").alias("violations"))


@query("INC10 MLE30 INC28", """
WITH b AS (SELECT page_id, page_id % 40 AS part, html FROM pages WHERE page_id % 40 <> 3), n AS (SELECT page_id, page_id % 40 AS part, CASE WHEN page_id % 40 = 5 THEN html || 'x' WHEN page_id % 40 = 6 THEN reverse(html) ELSE html END AS html FROM pages WHERE page_id % 40 <> 4 AND NOT (page_id % 40 = 7 AND page_id < 40)),
x AS (SELECT part, count(*) AS r, sum(strlen(html)) AS s, string_agg(sha256(html), ',' ORDER BY sha256(html)) AS d FROM b GROUP BY 1), y AS (SELECT part, count(*) AS r, sum(strlen(html)) AS s, string_agg(sha256(html), ',' ORDER BY sha256(html)) AS d FROM n GROUP BY 1)
SELECT coalesce(x.part, y.part) AS part, CASE WHEN y.part IS NULL THEN 'missing' WHEN x.part IS NULL THEN 'new' WHEN x.r <> y.r THEN 'rows' WHEN x.s <> y.s THEN 'bytes' WHEN x.d <> y.d THEN 'digest' ELSE 'same' END AS verdict FROM x FULL JOIN y ON x.part = y.part""")
def rebuild_verdicts(spark, sf):
    """Parts of the pages against a baseline of their counts, bytes and digests: one gone, one new, others changed in each of the three."""
    p, part = read(spark, sf, "pages").select("page_id", (F.col("page_id") % 40).alias("part"), "html"), F.col("part")
    changed = F.when(part == 5, F.concat("html", F.lit("x"))).when(part == 6, F.reverse("html")).otherwise(F.col("html"))
    now = p.filter((part != 4) & ~((part == 7) & (F.col("page_id") < 40))).withColumn("html", changed)
    return corpus.rebuilt(corpus.content(p.filter(part != 3), ["part"], "html"), corpus.content(now, ["part"], "html"), ["part"])


@query("FLT10", """
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'no settings' WHEN p_partkey % 11 = 0 THEN 'plugin' WHEN p_partkey % 7 = 0 THEN 'no android' WHEN p_partkey % 5 = 0 THEN 'desktop' WHEN p_size % 4 < 2 OR p_size % 4 = 2 AND p_size < 12 OR p_partkey % 17 = 0 THEN 'sdk' END AS why FROM part""")
def app_shapes(spark, sf):
    """Every part as a repository: its root entries and a settings file with a bound of its size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    bound = F.when(k % 17 == 0, F.lit("sdk: any")).otherwise(F.concat(F.when(k % 2 == 0, "sdk: '>=").otherwise("sdk: ^"), (size % 4).cast("string"), F.lit("."), size.cast("string"), F.when(k % 3 == 0, ".1 <9.0.0'").otherwise("")))
    text = F.when(k % 13 != 0, F.concat(F.lit("name: x\nenvironment:\n  "), bound, F.when(k % 11 == 0, "\nplugin:\n  platforms:\n").otherwise("\nplugin_free:\n")))
    entries = F.array_compact(F.array(F.lit("lib"), F.when(k % 7 != 0, "android"), F.when(k % 5 == 0, "macos")))
    return read(spark, sf, "part").select("p_partkey", corpus.app_shape(entries, text).alias("why"))


@query("JOI31", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' WHEN o_orderkey % 4 = 1 AND o_custkey % 2 = 0 THEN 'older' END AS replaced, CASE WHEN o_orderkey % 3 = 0 THEN 'by hand' WHEN o_orderkey % 4 = 1 AND o_custkey % 2 = 0 THEN 'backfilled' END AS applied,
o_orderkey % 3 = 0 OR o_orderkey % 4 = 1 AND o_custkey % 2 = 0 AS overridden FROM orders""")
def override_history(spark, sf):
    """Values of every order: a third was replaced before, some sit on their maximal arm and differ from the last commit, some cannot be decided."""
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    fresh = o.select(k, F.lit("now").alias("current"), F.when(k % 4 == 1, "now").when(k % 4 == 2, "other").alias("maximal"))
    prior = o.filter(k % 3 == 0).select(k, F.lit("kept").alias("replaced"), F.lit("by hand").alias("applied"))
    committed = o.select(k, F.when(F.col("o_custkey") % 2 == 0, "older").otherwise("now").alias("value"))
    return corpus.with_history(fresh, prior, committed, ["o_orderkey"]).select("o_orderkey", "replaced", "applied", "overridden")


@query("MLE28", """
WITH v AS (SELECT source AS claim, avg(quality) AS value FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT source AS claim, round(avg(quality), 2) + CASE WHEN substr(source, -1) = '3' THEN 0.5 ELSE 0 END AS reported FROM documents JOIN labels USING (doc_id) GROUP BY 1 UNION ALL SELECT 'nothing', 1.0)
SELECT r.claim, round(value, 6) AS value, round(reported, 6) AS reported, coalesce(abs(value - reported) <= 0.006, false) AS ok FROM r LEFT JOIN v ON v.claim = r.claim""")
def claimed_figures(spark, sf):
    """Rates of every source against rates as a report would quote them; a wrong one and one about nothing fail."""
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("claim")).join(read(spark, sf, "labels"), "doc_id")
    values = d.groupBy("claim").agg(F.avg("quality").alias("value"))
    quoted = values.select("claim", (F.round("value", 2) + F.when(F.endswith("claim", F.lit("3")), 0.5).otherwise(0.0)).alias("reported"))
    quoted = quoted.unionByName(spark.range(1).select(F.lit("nothing").alias("claim"), F.lit(1.0).alias("reported"))).withColumn("within", F.lit(0.006))
    out = corpus.claims(values, quoted, "claim", "within")
    return out.select("claim", F.round("value", 6).alias("value"), F.round("reported", 6).alias("reported"), "ok")

"""Source rules over fact rows, licence verdicts, text of tools. The rows are made of the driver's tables by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import facts, rules, stats
from ..operators import sourcerules as S
from ..sources import sinks
from ..sources.tables import read
from .registry import query

#: Facts that events stand for, by event_id; most say nothing to any rule.
FACTS = [
    "name:Text", "name:Column", "name:AnimatedIcon", "name:Padding", "invoked:Text", "name:SlideTransition", "mixin:SingleTickerProviderStateMixin", "name:Row", "name:Timer", "await:", "import:dart:ui",
    "import:dart:io", "name:WebViewController", "invoked:File", "qualified:Image.network", "qualified:http.get", "name:wantKeepAlive", "mixin:AutomaticKeepAliveClientMixin", "name:MaterialApp", "name:Stopwatch",
    "qualified:DateTime.now", "invoked:Random", "qualified:Theme.of", "async:", "name:Dio", "name:Ticker", *[f"name:Widget{k}" for k in range(60)],
]
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_IN = lambda xs: "(" + _LIST(xs)[1:-1] + ")"
_PICK = lambda xs, col: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(col, F.lit(len(xs))) + 1).cast("int"))


@query("R1 R2 R3 R4 R5 R6 RUL33", f"""
WITH e AS (SELECT event_id // 8 AS file, ({_LIST(FACTS)})[event_id * 37 % {len(FACTS)} + 1] AS f, event_type <> 'click' AS active FROM events),
x AS (SELECT file, split_part(f, ':', 1) AS k, substring(f, strpos(f, ':') + 1) AS v, active FROM e),
r AS (SELECT file, bool_or((k = 'name' AND (v IN {_IN(S.ANIMATION + S.ANIMATED)} OR (length(v) > 10 AND ends_with(v, 'Transition')))) OR (k = 'mixin' AND contains(v, 'TickerProvider'))) AS r1,
  bool_or(active AND (k IN ('await', 'async') OR (k = 'name' AND v IN {_IN(S.ASYNC)}))) AS r2,
  bool_or((k = 'import' AND v = 'dart:io') OR (active AND ((k = 'name' AND (v IN {_IN(S.IO)} OR starts_with(v, 'WebView') OR starts_with(v, 'VideoPlayer') OR starts_with(v, 'AudioPlayer'))) OR (k = 'invoked' AND v IN {_IN(S.IO_MADE)}) OR (k = 'qualified' AND (v = 'Image.network' OR starts_with(v, 'http.')))))) AS r3,
  bool_or(k IN ('name', 'mixin') AND v IN {_IN(S.KEEP_ALIVE)}) AS r4, bool_or(k = 'name' AND v IN {_IN(S.ROOTS)}) AS r5,
  bool_or((k = 'name' AND v IN {_IN(S.UNSTEADY)}) OR (k = 'qualified' AND v = 'DateTime.now') OR (k = 'invoked' AND v = 'Random')) AS r6 FROM x GROUP BY 1)
SELECT file, array_to_string(list_filter([CASE WHEN r1 THEN 'R1_animation' END, CASE WHEN r2 THEN 'R2_async' END, CASE WHEN r3 THEN 'R3_io_network' END, CASE WHEN r4 THEN 'R4_keepalive' END, CASE WHEN r5 THEN 'R5_nested_app' END, CASE WHEN r6 THEN 'R6_nondeterminism' END], lambda q: q IS NOT NULL), ',') AS rules FROM r""")
def source_rules(spark, sf):
    """A file is eight events; clicks stand for code that no rebuild reaches."""
    f = _PICK(FACTS, F.col("event_id") * 37)
    x = read(spark, sf, "events").select(F.floor(F.col("event_id") / 8).alias("file"), F.substring_index(f, ":", 1).alias("k"), f.alias("f"), (F.col("event_type") != "click").alias("active"))
    v = F.substring(F.col("f"), F.length("k") + 2, F.length("f"))
    of = lambda kind, live=False: F.collect_set(F.when((F.col("k") == kind) & (F.col("active") if live else F.lit(True)), v))
    flag = lambda kind: F.bool_or(F.col("active") & (F.col("k") == kind))
    facts = x.groupBy("file").agg(
        of("name").alias("names"), of("invoked").alias("invoked"), of("qualified").alias("qualified"), of("mixin").alias("mixins"), of("import").alias("imports"),
        of("name", True).alias("active_names"), of("invoked", True).alias("active_invoked"), of("qualified", True).alias("active_qualified"), flag("await").alias("active_await"), flag("async").alias("active_async"),
    )
    return rules.firings(facts, "file", S.source_rules()).select("file", F.array_join("rules", ",").alias("rules"))


@query("R0", """
WITH hand AS (SELECT doc_id AS id FROM labels WHERE quality = 0 UNION SELECT doc_id + 10000000 FROM labels WHERE toxic = 1)
SELECT hand.id, CASE WHEN d.doc_id IS NULL THEN 'unmatched' ELSE 'R0_manual' END AS verdict FROM hand LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = hand.id""")
def manual_list(spark, sf):
    """Ids of a hand-kept list exclude their group; ids that no group has are reported."""
    labels = read(spark, sf, "labels")
    hand = labels.filter("quality = 0").select(F.col("doc_id").alias("id")).union(labels.filter("toxic = 1").select((F.col("doc_id") + 10_000_000).alias("id"))).distinct()
    groups = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("R0_manual").alias("verdict")).distinct()
    return hand.join(groups, "id", "left").select("id", F.coalesce("verdict", F.lit("unmatched")).alias("verdict"))


@query("R10 R11 R12 R14", """
WITH r AS (SELECT o_orderkey AS file, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS verified, nullif(o_orderkey % 5, 4) % 2 AS errors, CASE o_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS resolved,
  CASE WHEN o_orderkey % 11 = 0 THEN true END AS reverted, o_orderkey % 13 = 0 AS truncated, nullif(o_custkey % 4, 3) AS closure FROM orders)
SELECT file, array_to_string(list_filter([CASE WHEN verified IS NOT NULL AND (NOT verified OR coalesce(errors, 0) > 0) THEN 'R10_unverified' END, CASE WHEN resolved IS NOT DISTINCT FROM false THEN 'R11_source_unresolved' END,
  CASE WHEN coalesce(reverted, false) OR coalesce(truncated, false) THEN 'R12_inline_reverted' END, CASE WHEN closure IS DISTINCT FROM 1 THEN 'R14_short_vector' END], lambda q: q IS NOT NULL), ',') AS rules FROM r""")
def row_rules(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf, "orders").select(
        k.alias("file"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("verified"), (F.nullif(k % 5, F.lit(4)) % 2).alias("errors"),
        F.when(c % 3 == 0, False).when(c % 3 == 1, True).alias("source_resolved"), F.when(k % 11 == 0, True).alias("reverted"), (k % 13 == 0).alias("truncated"), F.nullif(c % 4, F.lit(3)).alias("closure"),
    )
    return rules.firings(rows, "file", S.row_rules()).select("file", F.array_join("rules", ",").alias("rules"))


@query("R8 R9", """
WITH g AS (SELECT c.c_custkey AS gid, c.c_nationkey AS project, count(o.o_orderkey) AS files, c.c_custkey % 10 = 0 AS held FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT gid, files, files < 2 AND NOT held AS r8, project NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS r9 FROM g""")
def group_rules(spark, sf):
    """R8: fewer than two files and not held. R9: the project has no checkpoint."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("gid"), F.col("c_nationkey").alias("project"))
    n = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("gid")).agg(F.count("*").alias("files"))
    done = read(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("project"), F.lit(True).alias("done")).distinct()
    g = c.join(n, "gid", "left").withColumn("files", F.coalesce("files", F.lit(0))).join(done, "project", "left")
    return g.select("gid", "files", ((F.col("files") < 2) & (F.col("gid") % 10 != 0)).alias("r8"), F.col("done").isNull().alias("r9"))


ALLOWED = ["MIT", "BSD-3-Clause", "Apache-2.0"]
_PACKAGES = "CASE s.s_nationkey % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'BSD-3-Clause' WHEN 2 THEN 'Apache-2.0' WHEN 3 THEN 'GPL-3.0-only' END"


@query("R17 JOI12", f"""
WITH p AS (SELECT l_partkey AS k, list(DISTINCT s.s_name) AS names, min(s.s_name) FILTER (s.s_suppkey % 20 = 4) AS unread, string_agg(DISTINCT s.s_name, ';' ORDER BY s.s_name) FILTER (coalesce({_PACKAGES}, '') NOT IN {_IN(ALLOWED)}) AS bad
  FROM lineitem JOIN supplier s ON s.s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1),
f AS (SELECT *, p_size % 4 AS inlined, p_size % 9 = 0 AS reverted, p_size % 11 = 0 AS truncated, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 5 <> 0 END AS same FROM part LEFT JOIN p ON p.k = p_partkey)
SELECT p_partkey AS file, CASE WHEN inlined = 0 OR reverted THEN 'pass' WHEN truncated OR same IS NULL OR NOT same OR names IS NULL OR unread IS NOT NULL THEN 'unattributed' WHEN bad IS NOT NULL THEN 'disallowed' ELSE 'pass' END AS kind,
  CASE WHEN inlined = 0 OR reverted THEN '' WHEN truncated THEN 'truncated' WHEN same IS NULL THEN 'no provenance' WHEN NOT same THEN 'another file' WHEN names IS NULL THEN 'no package' WHEN unread IS NOT NULL THEN 'unread ' || unread ELSE coalesce(bad, '') END AS why FROM f""")
def package_licence(spark, sf):
    """File to provenance to packages to licence: parts are files, suppliers of some of their lines the packages."""
    n = F.col("s_nationkey") % 5
    spdx = F.when(n == 0, "MIT").when(n == 1, "BSD-3-Clause").when(n == 2, "Apache-2.0").when(n == 3, "GPL-3.0-only")
    package = F.struct(F.col("s_name").alias("name"), spdx.alias("spdx"), (F.col("s_suppkey") % 20 != 4).alias("readable"))
    used = read(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey", "l_suppkey").distinct()
    p = used.join(read(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(package).alias("packages"))
    size, key = F.col("p_size"), F.col("p_partkey")
    f = read(spark, sf, "part").join(p, "p_partkey", "left").select(key.alias("file"), (size % 4).alias("inlined"), (size % 9 == 0).alias("reverted"), (size % 11 == 0).alias("truncated"), F.when(key % 6 != 0, key % 5 != 0).alias("bytes_identical"), "packages")
    v = S.package_licence(ALLOWED)
    return f.withColumn("v", v).select("file", "v.kind", "v.why")


@query("R18 JOI13 FLT08", """
WITH c AS (SELECT s_nationkey AS project, min(CASE s_suppkey % 4 WHEN 0 THEN 'mit license' WHEN 1 THEN 'Apache License 2.0' WHEN 2 THEN 'gnu gpl v3' ELSE 'unlicensed' END) AS recorded FROM supplier WHERE s_acctbal > 3000 GROUP BY 1),
g AS (SELECT c_custkey AS gid, c.project IS NOT NULL AS seen, CASE lower(coalesce(recorded, '')) WHEN 'mit license' THEN 'MIT' WHEN 'apache license 2.0' THEN 'Apache-2.0' WHEN 'gnu gpl v3' THEN 'GPL-3.0-only' END AS spdx FROM customer LEFT JOIN c ON c.project = c_nationkey)
SELECT gid, CASE WHEN NOT seen THEN 'unrecorded' WHEN spdx IS NULL THEN 'unmapped' WHEN spdx NOT IN ('MIT', 'BSD-3-Clause', 'Apache-2.0') THEN 'disallowed ' || spdx END AS reason FROM g""")
def repo_licence(spark, sf):
    k = F.col("s_suppkey") % 4
    named = F.when(k == 0, "mit license").when(k == 1, "Apache License 2.0").when(k == 2, "gnu gpl v3").otherwise("unlicensed")
    c = read(spark, sf, "supplier").filter("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min(named).alias("recorded"), F.lit(True).alias("seen"))
    g = read(spark, sf, "customer").join(c, "c_nationkey", "left")
    reason = S.repo_licence(F.col("recorded"), F.coalesce("seen", F.lit(False)), {"mit license": "MIT", "apache license 2.0": "Apache-2.0", "gnu gpl v3": "GPL-3.0-only"}, ALLOWED)
    return g.select(F.col("c_custkey").alias("gid"), reason.alias("reason"))


@query("R21 R22", """
WITH e AS (SELECT l_orderkey, l_linenumber, l_linenumber <> 1 AS shot, CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 'x' END AS exception, l_discount / 4 AS grey, l_tax / 3 AS red, 0.99 + l_quantity / 5000 AS flat FROM lineitem)
SELECT verdict, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM (SELECT *, CASE WHEN exception IS NOT NULL OR (shot AND (grey >= 0.02 OR red >= 0.02)) THEN 'renders_error' WHEN NOT shot THEN 'unknown' WHEN flat >= 0.999 THEN 'renders_nothing' ELSE 'renders' END AS verdict FROM e) GROUP BY 1""")
def render_rules(spark, sf):
    c = F.col
    v = S.render_verdict(c("l_linenumber") != 1, F.when((c("l_returnflag") == "R") & (c("l_quantity") > 49), "x"), c("l_discount") / 4, c("l_tax") / 3, 0.99 + c("l_quantity") / 5000)
    return read(spark, sf, "lineitem").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


#: Lines of source that events stand for.
LINES = [
    "import 'package:flutter/material.dart';", "import 'package:own/a.dart';", "import 'package:fancy_icons/b.dart';", "import 'dart:ui';", "Icon(FontAwesomeIcons.user)", "Icon(Icons.add)", "Icon(CupertinoIcons.back)",
    "TextStyle(fontFamily: 'Roboto', size: 1)", "TextStyle(fontFamily: 'monospace', size: 2)", "// import 'package:x/y.dart';", "Icon(myIcons.one)",
]
_EDIT = r"""regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(s, '\bCupertinoIcons\.', chr(1) || '.', 'g'), '\b[A-Z][A-Za-z]*Icons\.\w+', 'Icons.circle', 'g'), chr(1) || '.', 'CupertinoIcons.'),
 'fontFamily: ''(serif|sans-serif|monospace)''', 'fontFamily: "\1"', 'g'), 'fontFamily: ''[^'']*'',? ?', '', 'g')"""


@query("RUL28 RUL29 RUL30", f"""
WITH e AS (SELECT event_id // 20 AS file, event_id, ({_LIST(LINES)})[event_id * 7 % {len(LINES)} + 1] AS l FROM events),
t AS (SELECT file, count(*) AS lines, coalesce(string_agg(l, chr(10) ORDER BY event_id) FILTER (NOT regexp_matches(l, '^import ''package:') OR regexp_matches(l, '^import ''package:(flutter|own)/')), '') AS s FROM e GROUP BY 1)
SELECT file, sha256({_EDIT}) AS sha256, length({_EDIT}) AS n FROM t""")
def foreign_edits(spark, sf):
    rows = read(spark, sf, "events").select(F.floor(F.col("event_id") / 20).alias("file"), F.struct("event_id", _PICK(LINES, F.col("event_id") * 7).alias("l")).alias("r"))
    s = rows.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("r"))["l"], "\n").alias("s")).withColumn("s", S.foreign_edits(F.col("s")))
    return s.select("file", F.sha2("s", 256).alias("sha256"), F.length("s").cast("long").alias("n"))


@query("SRC11 SRC12 FLT06 FLT16", """
WITH e AS (SELECT user_id, event_id, greatest(CAST(floor(value) AS BIGINT) - 20, 0) AS us FROM events)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, us FROM e WHERE us > 0""")
def stdout_readings(spark, sf):
    """A user's log has one line to an event; spans are read back by a pattern, empty ones go before the index is given."""
    line = F.concat(F.lit("I/x BUILD us="), F.greatest(F.floor("value") - 20, F.lit(0)).cast("string"), F.lit(" end"))
    logs = read(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l"))))["l"], "\n").alias("log"))
    found = logs.select("user_id", F.posexplode(F.regexp_extract_all("log", F.lit(r"BUILD us=(\d+)"), 1)).alias("pos", "us")).select("user_id", "pos", F.col("us").cast("long").alias("us"))
    return found.filter("us > 0").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("pos")) - 1).cast("long").alias("idx"), "us")


@query("SRC22", """
SELECT o_orderkey AS commit, epoch(o_orderdate)::BIGINT AS at, 'price ' || o_custkey || repeat('x', 210 - length('price ' || o_custkey) - CASE WHEN o_custkey % 2 = 0 THEN 100 ELSE 10 END) AS subject, o_custkey % 3 AS files FROM orders""")
def git_log(spark, sf):
    """A customer's log, block by block; of the names below a commit only those with the suffix stay."""
    subject = F.concat(F.lit("price "), F.col("o_custkey").cast("string"))
    tail = F.when(F.col("o_custkey") % 2 == 0, 100).otherwise(10)
    full = F.rpad(subject, 210 - tail, "x")
    head = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"), F.lit("author"), full)
    names = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.when(k < F.col("o_custkey") % 3, F.concat(F.lit("lib/"), k.cast("string"), F.lit(".dart"))).otherwise("readme.md")), "\n")
    logs = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(F.lit("\x00"), head, F.lit("\n"), names)), "").alias("log"))
    c = logs.select(F.explode(S.commits(F.col("log"), ".dart")).alias("c"))
    return c.select(F.col("c.commit").cast("long").alias("commit"), F.col("c.at").alias("at"), F.col("c.subject").alias("subject"), F.size("c.files").cast("long").alias("files"))


@query("SRC23", """
SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS found, count(*) FILTER (o_orderstatus = 'F') AS errors, min('lib/' || o_orderkey || '.dart') FILTER (o_orderstatus <> 'P') AS first_path FROM orders GROUP BY 1""")
def analyzer_output(spark, sf):
    k = F.concat(F.lit("lib/"), F.col("o_orderkey").cast("string"), F.lit(".dart"))
    line = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("error|UNDEFINED_NAME|"), k)).when(F.col("o_orderstatus") == "O", F.concat(F.lit("  warning - Unused - in place - "), k, F.lit(" - unused_import"))).otherwise("Analyzing ...")
    out = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "\n").alias("out")).withColumn("d", S.diagnostics(F.col("out")))
    return out.select("o_custkey", F.size("d").cast("long").alias("found"), F.size(F.filter("d", lambda x: (x["severity"] == "error") & (x["code"] == "undefined_name"))).cast("long").alias("errors"), F.array_min(F.transform("d", lambda x: x["path"])).alias("first_path"))


@query("SRC27 SCA30", """
SELECT s_suppkey, (s_suppkey % 9)::VARCHAR || '.' || (s_nationkey % 10) || '.0' AS version, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 5)::VARCHAR || '.2.1' END AS needed FROM supplier""")
def lock_versions(spark, sf):
    """The version a lock file pins, and the one an error text asks for; a later line of that text wins."""
    k = F.col("s_suppkey")
    v = F.concat((k % 9).cast("string"), F.lit("."), (F.col("s_nationkey") % 10).cast("string"), F.lit(".0"))
    lock = F.concat(F.lit('packages:\n  args:\n    source: hosted\n    version: "9.9.9"\n  flutter_lints:\n    dependency: dev\n    description:\n      name: flutter_lints\n    version: "'), v, F.lit('"\n  zone:\n    version: "1.0.0"\n'))
    text = F.concat(F.lit("args 0.0.1 is required\n"), F.when(k % 2 == 0, F.concat(F.lit("lints 7.7.7 is required\nand lints "), (k % 5).cast("string"), F.lit(".2.1 is required"))).otherwise(""))
    return read(spark, sf, "supplier").select("s_suppkey", S.lock_version(lock, "flutter_lints").alias("version"), S.required_versions(text)["lints"].alias("needed"))


@query("SCA20", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1614729600 WHEN 1 THEN 1683676800 WHEN 2 THEN epoch(CAST(o_orderdate AS DATE))::BIGINT ELSE -1 END AS since FROM orders""")
def since_dates(spark, sf):
    k = F.col("o_orderkey") % 4
    given = F.when(k == 0, "null-safety").when(k == 1, "dart3").when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    # The dates behind the aliases.
    return read(spark, sf, "orders").select("o_orderkey", S.since_epoch(given, {"null-safety": "2021-03-03", "dart3": "2023-05-10"}).alias("since")).fillna(-1)


#: Conditions that events stand for.
CONDITIONS = ["f", "!f", "f != null", "f == null", " f ", "f == 3", "f && g", "g", "f.isEmpty"]


@query("SCA24", f"""
SELECT event_id, CASE WHEN c IN ('f', 'f != null') THEN 'then' WHEN c IN ('!f', 'f == null') THEN 'else' WHEN regexp_matches(c, '^f == \\S+$') THEN 'then_if_equal' ELSE 'unknown' END AS arm FROM (SELECT event_id, trim(({_LIST(CONDITIONS)})[event_id % {len(CONDITIONS)} + 1]) AS c FROM events)""")
def condition_arms(spark, sf):
    return read(spark, sf, "events").select("event_id", S.condition_arm(_PICK(CONDITIONS, F.col("event_id")), "f").alias("arm"))


@query("SCA27", """
WITH p AS (SELECT event_type AS l, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, event_id FROM events)
SELECT event_id, (l = 'view')::INT AS l_view, (l = 'click')::INT AS l_click, (l = 'error')::INT AS l_error, (r = 'view')::INT AS r_view, (r = 'click')::INT AS r_click, (r = 'error')::INT AS r_error FROM p WHERE r IS NOT NULL""")
def directive_onehot(spark, sf):
    p = read(spark, sf, "events").select("event_id", F.col("event_type").alias("l"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("r")).filter("r IS NOT NULL")
    return p.select("event_id", *[(F.col(s) == v).cast("int").alias(f"{s}_{v}") for s in "lr" for v in ("view", "click", "error")])


@query("SCA06 SET07", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents), s AS (SELECT source, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS d FROM t GROUP BY 1)
SELECT doc_id, sha256(t || chr(0) || d) AS cache_key, len(list_distinct(regexp_extract_all(t, '[A-Z]{2,}')))::BIGINT AS signature FROM t JOIN s USING (source)""")
def role_cache_key(spark, sf):
    """Key of a text with the digest of its group's fixture; size of the set that its content signature compares."""
    t = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "source")
    s = t.groupBy("source").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ","), 256).alias("d"))
    key = F.sha2(F.concat("t", F.lit("\x00"), "d"), 256)
    return t.join(F.broadcast(s), "source").select("doc_id", key.alias("cache_key"), F.size(F.array_distinct(F.regexp_extract_all("t", F.lit("[A-Z]{2,}"), 0))).cast("long").alias("signature"))


@query("SET06", "SELECT count(*) AS collisions FROM (SELECT DISTINCT lower(n_name) FROM nation INTERSECT SELECT DISTINCT lower(r_name) FROM region)")
def namespace_collisions(spark, sf):
    """Names that two counters share; none may be."""
    a, b = read(spark, sf, "nation").select(F.lower("n_name").alias("n")), read(spark, sf, "region").select(F.lower("r_name").alias("n"))
    return a.intersect(b).agg(F.count("*").alias("collisions"))


@query("FLT09", """
SELECT page_id, array_to_string(list_filter(['pubspec.yaml', 'android'], lambda x: NOT list_contains(e, x)), ',') AS missing FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ['android', 'lib', 'pubspec.yaml'] WHEN 1 THEN ['lib', 'pubspec.yaml'] WHEN 2 THEN ['android'] ELSE ['web'] END AS e FROM pages)""")
def root_entries(spark, sf):
    """What a repository's root lacks of the entries an application has."""
    k = F.col("page_id") % 4
    row = lambda *xs: F.array(*[F.lit(x) for x in xs])
    e = F.when(k == 0, row("android", "lib", "pubspec.yaml")).when(k == 1, row("lib", "pubspec.yaml")).when(k == 2, row("android")).otherwise(row("web"))
    return read(spark, sf, "pages").select("page_id", F.array_join(F.array_except(row("pubspec.yaml", "android"), e), ",").alias("missing"))


@query("RUL36", """
WITH e AS (SELECT user_id, event_id, event_type IN ('signup', 'purchase', 'error') AS banner, event_type, floor(value) % 3 = 0 AS empty FROM events),
s AS (SELECT *, coalesce(last_value(CASE WHEN banner THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'none') AS section FROM e)
SELECT section, count(*) AS members, count(*) FILTER (section = 'signup' OR empty) AS needs_value FROM s WHERE NOT banner GROUP BY 1""")
def banner_sections(spark, sf):
    """Members belong to the last banner above them; those of one section, and empty ones, need a value."""
    banner = F.col("event_type").isin("signup", "purchase", "error")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = read(spark, sf, "events").select(banner.alias("banner"), (F.floor("value") % 3 == 0).alias("empty"), F.coalesce(F.last(F.when(banner, F.col("event_type")), ignorenulls=True).over(w), F.lit("none")).alias("section"))
    return s.filter("NOT banner").groupBy("section").agg(F.count("*").alias("members"), F.count_if((F.col("section") == "signup") | F.col("empty")).alias("needs_value"))


@query("RUL21 RUL38", """
WITH k(event_type, known) AS (VALUES ('view', 'widget'), ('click', 'widget'), ('purchase', 'other'))
SELECT event_id // 10 AS branch, user_id % 2 AS arm, count(*) FILTER (known = 'widget') AS widgets, count(*) FILTER (known = 'other') AS others, count(*) FILTER (known IS NULL) AS unknown, bool_or(value > 200) AS lazy FROM events LEFT JOIN k USING (event_type) GROUP BY 1, 2""")
def arm_counts(spark, sf):
    known = spark.createDataFrame([("view", "widget"), ("click", "widget"), ("purchase", "other")], "event_type string, known string")
    e = read(spark, sf, "events").join(F.broadcast(known), "event_type", "left")
    return e.groupBy(F.floor(F.col("event_id") / 10).alias("branch"), (F.col("user_id") % 2).alias("arm")).agg(F.count_if(F.col("known") == "widget").alias("widgets"), F.count_if(F.col("known") == "other").alias("others"), F.count_if(F.col("known").isNull()).alias("unknown"), F.bool_or(F.col("value") > 200).alias("lazy"))


@query("AGG16", """
WITH l AS (SELECT l.*, o_custkey, o_orderstatus FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)
SELECT count(*) AS pairs, count(*) FILTER (l_returnflag <> 'R') AS eligible, count(*) FILTER (l_linenumber <= 2) AS adjacent, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber <= 2) AS adjacent_eligible, count(DISTINCT l_orderkey) AS scopes,
 count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END) AS scopes_eligible, count(DISTINCT o_custkey) AS repositories, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN o_custkey END) AS repositories_eligible, count(*) FILTER (l_quantity > 25) AS measurable,
 count(DISTINCT CASE WHEN l_quantity > 25 THEN l_orderkey END) AS scopes_measurable, count(*) FILTER (o_orderstatus = 'P') AS held, count(*) FILTER (l_discount = 0) AS zero_delta, count(*) FILTER (l_tax = 0) AS untaxed, count(*) FILTER (l_linestatus = 'F') AS finished,
 count(DISTINCT l_suppkey) AS suppliers, round(count(*) FILTER (l_returnflag <> 'R')::DOUBLE / count(*), 4) AS share FROM l""")
def totals_block(spark, sf):
    """Sixteen measures in one pass after one join."""
    l = read(spark, sf, "lineitem").join(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"))  # noqa: E741
    ok, near, wide = F.col("l_returnflag") != "R", F.col("l_linenumber") <= 2, F.col("l_quantity") > 25
    some = lambda p, c: F.count_distinct(F.when(p, F.col(c)))
    return l.agg(
        F.count("*").alias("pairs"), F.count_if(ok).alias("eligible"), F.count_if(near).alias("adjacent"), F.count_if(ok & near).alias("adjacent_eligible"), F.count_distinct("l_orderkey").alias("scopes"), some(ok, "l_orderkey").alias("scopes_eligible"),
        F.count_distinct("o_custkey").alias("repositories"), some(ok, "o_custkey").alias("repositories_eligible"), F.count_if(wide).alias("measurable"), some(wide, "l_orderkey").alias("scopes_measurable"), F.count_if(F.col("o_orderstatus") == "P").alias("held"),
        F.count_if(F.col("l_discount") == 0).alias("zero_delta"), F.count_if(F.col("l_tax") == 0).alias("untaxed"), F.count_if(F.col("l_linestatus") == "F").alias("finished"), F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.count_if(ok) / F.count("*"), 4).alias("share"),
    )


@query("JOI28", """
SELECT doc_id, doc_id % 5 AS fold, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents""")
def fold_positions(spark, sf):
    """Stored folds are lists of ids; each id finds the position of its row. Positions come from counts by range of ids, then inside a range."""
    d = read(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 1000).alias("range"))
    folds = d.groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.collect_list("doc_id").alias("ids")).select("fold", F.explode("ids").alias("doc_id"))
    n = d.groupBy("range").agg(F.count("*").alias("n"))
    below = n.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    at = d.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy("doc_id"))).join(below, "range")
    return folds.join(at, "doc_id").select("doc_id", "fold", (F.col("below") + F.col("k") - 1).alias("position"))


@query("JOI26 JOI24", """
WITH gate AS (SELECT c_nationkey AS scope, c_custkey AS gid FROM customer WHERE c_acctbal > 0)
SELECT g.scope::BIGINT AS scope, o.o_orderdate::DATE::VARCHAR AS day, string_agg(g.gid || ':' || o.o_orderkey, ',' ORDER BY g.gid, o.o_orderkey) AS revisions FROM gate g JOIN orders o ON o.o_custkey = g.gid WHERE o.o_orderstatus <> 'P' GROUP BY 1, 2""")
def needed_revisions(spark, sf):
    """Trusted groups of a scope, and by commit (here: day) their revisions that still need attribution, keyed by group and file."""
    gate = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").cast("long").alias("scope"), F.col("c_custkey").alias("gid"))
    o = read(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("gid"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    g = gate.join(o, "gid").groupBy("scope", "day").agg(F.array_sort(F.collect_list(F.struct("gid", "o_orderkey"))).alias("r"))
    return g.select("scope", "day", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["gid"].cast("string"), x["o_orderkey"].cast("string"))), ",").alias("revisions"))


@query("SCA18", """
SELECT o_orderkey, 3 + (o_orderkey % 2) AS n, 'f(' || o_custkey || ', [1, 2])' AS first, CASE WHEN o_orderkey % 2 = 1 THEN '''a, b''' ELSE '{k: (1, 2)}' END AS last FROM orders""")
def split_arguments(spark, sf):
    """Argument lists cut at commas outside brackets and strings."""
    k = F.col("o_orderkey") % 2
    text = F.concat(F.lit("f("), F.col("o_custkey").cast("string"), F.lit(", [1, 2]), "), F.lit("x"), F.when(k == 1, ", y, 'a, b'").otherwise(", {k: (1, 2)}"))
    parts = read(spark, sf, "orders").select("o_orderkey", facts.split_top_level(text).alias("p"))
    return parts.select("o_orderkey", F.size("p").cast("long").alias("n"), F.col("p")[0].alias("first"), F.element_at("p", -1).alias("last"))


@query("RUL07", "SELECT count(*) AS rows FROM orders WHERE o_orderstatus <> 'P'")
def scoped_rows(spark, sf):
    """Rows that may be used; one without a scope fails the job."""
    o = read(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    sinks.require_none(o.filter("o_custkey IS NULL"), "a row without a scope")
    return o.agg(F.count("*").alias("rows"))


@query("SCA29", """
SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS code_lines, min(o_orderkey) FILTER (o_orderstatus = 'F') AS first_exception FROM orders GROUP BY 1""")
def stripped_log(spark, sf):
    """Comment and banner lines go from a text; of the rest the first exception line gives its message."""
    k = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("// note "), k)).when(F.col("o_orderstatus") == "F", F.concat(F.lit("Exception: no "), k, F.lit(" // seen"))).otherwise(F.concat(F.lit("run "), k))
    t = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l"))))["l"], "\n").alias("t"))
    code = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(F.regexp_replace(x, r"//.*$", ""))), lambda x: x != "")
    hit = F.filter(code, lambda x: F.startswith(x, F.lit("Exception: ")))
    return t.select("o_custkey", F.size(code).cast("long").alias("code_lines"), F.regexp_extract(F.try_element_at(hit, F.lit(1)), r"no (\d+)", 1).try_cast("long").alias("first_exception"))


@query("INC25", """
WITH RECURSIVE need(node, v) AS (SELECT n_nationkey, n_regionkey FROM nation), f(node, v) AS (SELECT node, v FROM need UNION SELECT n.n_nationkey, f.v FROM f JOIN nation n ON n.n_nationkey = f.node + 3 WHERE f.v > n.n_regionkey)
SELECT node::BIGINT AS node, max(v)::BIGINT AS level FROM f GROUP BY 1""")
def override_rounds(spark, sf):
    """Overrides accumulate: a version that one package asks for binds those that depend on it, round by round until none is new."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("level"))
    return facts.propagate(n, n.select((F.col("node") - 3).alias("src"), "node"))


@query("AGG31", """
WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT 'l_quantity' AS feature, round((1 - c * c) / det, 6) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 6) FROM d UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 6) FROM d""")
def inflation_factors(spark, sf):
    return stats.inflation_factors(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("feature", F.round("vif", 6).alias("vif"))

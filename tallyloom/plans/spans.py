"""Spans of documents and pages: innermost region, edits applied, bodies and initialisers, what logs say was thrown."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import spans
from ..sources.tables import events, read
from .registry import query


def _found_sql(name: str, table: str, key: str, text: str, pattern: str) -> str:
    """CTE `name`: key, s, e, found of every match, offsets in bytes, by running sums over gaps and matches."""
    return f"""{name}_p AS (SELECT {key}, string_split_regex({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS hits FROM {table}),
{name}_r AS (SELECT {key}, i, gaps[i] AS gap, hits[i] AS found FROM (SELECT {key}, gaps, hits, unnest(range(1, len(gaps) + 1)) AS i FROM {name}_p)),
{name}_c AS (SELECT {key}, found, sum(strlen(gap) + coalesce(strlen(found), 0)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM {name}_r),
{name} AS (SELECT {key}, found, CAST(e - strlen(found) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM {name}_c WHERE found IS NOT NULL)"""


@query("RUL34", f"""
WITH {_found_sql("par", "documents", "doc_id", "text", "[^\\n]+")}, {_found_sql("sen", "documents", "doc_id", "text", "[^.\\n]+")}, {_found_sql("cap", "documents", "doc_id", "text", "[A-Z]+")},
spans AS (SELECT doc_id, s, e, CASE WHEN e - s > 300 THEN 'long paragraph' ELSE 'paragraph' END AS kind FROM par UNION ALL SELECT doc_id, s, e, CASE WHEN e - s > 60 THEN 'long sentence' ELSE 'sentence' END FROM sen WHERE e - s > 20
  UNION ALL SELECT doc_id, s, s + 9, 'notice' FROM par WHERE starts_with(found, 'Copyright')),
top AS (SELECT doc_id, min(s) AS s FROM spans WHERE kind = 'notice' GROUP BY 1),
hit AS (SELECT cap.doc_id, cap.s, arg_min(kind, (-spans.s, spans.e, kind)) AS region FROM cap JOIN spans ON spans.doc_id = cap.doc_id AND spans.s <= cap.s AND cap.s < spans.e GROUP BY 1, 2)
SELECT cap.doc_id, coalesce(CASE WHEN cap.s >= top.s THEN 'notice' ELSE region END, 'none') AS region, count(*) AS points
FROM cap LEFT JOIN hit ON hit.doc_id = cap.doc_id AND hit.s = cap.s LEFT JOIN top ON top.doc_id = cap.doc_id GROUP BY 1, 2""")
def innermost_span(spark, sf):
    """Runs of capitals in the sentences and paragraphs of every document; short sentences are no spans, a notice outranks what follows it."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    size = F.col("end") - F.col("start")
    par = spans.find_edits(d, "doc_id", "text", r"[^\n]+", lambda found: F.startswith(found, F.lit("Copyright")))
    sen = spans.find_edits(d, "doc_id", "text", r"[^.\n]+").filter(size > 20)
    of = lambda rows, kind: rows.select("doc_id", "start", "end", kind.alias("kind"))
    notice = par.filter("found").select("doc_id", "start", (F.col("start") + 9).alias("end"), F.lit("notice").alias("kind"))
    every = of(par, F.when(size > 300, "long paragraph").otherwise("paragraph")).unionByName(of(sen, F.when(size > 60, "long sentence").otherwise("sentence"))).unionByName(notice)
    points = spans.find_edits(d, "doc_id", "text", "[A-Z]+").select("doc_id", F.col("start").alias("at"))
    found = spans.innermost(points, every, "doc_id", "at", "kind", above="notice")
    return found.groupBy("doc_id", F.coalesce("region", F.lit("none")).alias("region")).agg(F.count("*").alias("points"))


_URL = r"https?://[^\x20\x09-\x0D]+"


@query("RUL31", f"""
WITH a AS (SELECT doc_id, text, regexp_replace(text, '{_URL}', '<link>', 'g') AS t FROM documents), b AS (SELECT *, regexp_replace(t, '[0-9]+', '#', 'g') AS u FROM a)
SELECT doc_id, len(regexp_extract_all(text, '{_URL}')) AS links, len(regexp_extract_all(t, '[0-9]+')) AS numbers, len(regexp_extract_all(u, '[A-Z][A-Z]+')) AS names, sha256(regexp_replace(u, '[A-Z][A-Z]+', '<name>', 'g')) AS sha FROM b""")
def applied_edits(spark, sf):
    """Links, numbers and runs of capitals of every document replaced by edits at their offsets, counted by kind."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    e = spans.find_edits(d, "doc_id", "text", rf"{_URL}|[0-9]+|[A-Z][A-Z]+")
    kind = F.when(F.startswith("found", F.lit("http")), "links").when(F.col("found").rlike("^[0-9]"), "numbers").otherwise("names")
    e = e.select("doc_id", "start", "end", kind.alias("kind")).withColumn("replacement", F.when(F.col("kind") == "links", "<link>").when(F.col("kind") == "numbers", "#").otherwise("<name>"))
    done = spans.apply_edits(d, e, "doc_id", "text", ["links", "numbers", "names"])
    return done.select("doc_id", *(F.col(f"n_{k}").alias(k) for k in ("links", "numbers", "names")), F.sha2("rewritten", 256).alias("sha"))


@query("SCA16", """
WITH s AS (SELECT page_id, html || ' class A { void init() { a(); } Widget build(c) ' || repeat('{ if (c) ', page_id % 4) || '{ return f' || page_id || '; }' || repeat(' else { x(); } }', page_id % 4) || CASE WHEN page_id % 9 > 0 THEN ' void end() {} }' ELSE '' END AS t FROM pages),
r AS (SELECT page_id, regexp_extract(t, 'Widget build\\([^)]*\\)(.*)', 1, 's') AS rest FROM s),
x AS (SELECT page_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(rest, '[{}]|[^{}]+') AS ts FROM r)),
d AS (SELECT page_id, i, ts[i] AS tok, sum(CASE ts[i] WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM x),
z AS (SELECT page_id, min(i) FILTER (tok = '}' AND depth = 0) AS z FROM d GROUP BY 1)
SELECT page_id, string_agg(tok, '' ORDER BY i) AS block FROM d JOIN z USING (page_id) WHERE i <= z AND i > 1 GROUP BY 1""")
def method_bodies(spark, sf):
    """The body of build in a source behind each page's own style rules; a fifth nested more deeply than the page."""
    k = F.col("page_id")
    body = F.concat(F.expr("repeat('{ if (c) ', cast(page_id % 4 as int))"), F.lit("{ return f"), k.cast("string"), F.lit("; }"), F.expr("repeat(' else { x(); } }', cast(page_id % 4 as int))"))
    text = F.concat("html", F.lit(" class A { void init() { a(); } Widget build(c) "), body, F.when(k % 9 > 0, " void end() {} }").otherwise(""))
    out = spans.brace_block(read(spark, sf, "pages").select("page_id", text.alias("t")), "page_id", "t", r"\bWidget build\([^)]*\)")
    return out.select("page_id", "block").filter("block IS NOT NULL")


@query("SCA17 SCA18", """
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN NULL ELSE '[ ' || page_id || ', f(''];''), {k: (1, "b;")}]' END AS built, nullif(regexp_extract(html, 'var t=("[^"]*");', 1), '') AS scripted FROM pages""")
def initialisers(spark, sf):
    """What the script of each page assigns, and a list written over lines with comments, strings that hold its ends, and a fifth that never ends."""
    k = F.col("page_id").cast("string")
    end = F.when(F.col("page_id") % 5 == 4, "").otherwise("\n ; // done")
    text = F.concat(F.lit("// final items;\nfinal items = [\n  "), k, F.lit(",   f('];'), // ];\n  {k: /* ; */ (1, \"b;\")}]"), end)
    p = read(spark, sf, "pages").select("page_id", "html", text.alias("t"))
    built = spans.initialiser(p.select("page_id", "t"), "page_id", "t", r"\bfinal items").select("page_id", F.col("init").alias("built"))
    return built.join(spans.initialiser(p.select("page_id", "html"), "page_id", "html", r"\bvar t").select("page_id", F.col("init").alias("scripted")), "page_id")


@query("SCA23", """
WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, min(n) FILTER (event_type = 'error' AND event_id % 2 = 0) AS f, arg_min(event_id, n) FILTER (event_id % 211 = 3) AS named FROM l GROUP BY 1),
m AS (SELECT l.user_id, max(n) AS n FROM l JOIN f ON f.user_id = l.user_id WHERE n BETWEEN f - 39 AND f - 1 AND event_id % 17 = 1 AND NOT (event_type = 'error' AND event_id % 2 = 0) AND event_id % 211 <> 3 GROUP BY 1)
SELECT f.user_id, CASE WHEN named IS NOT NULL THEN 'broke ' || named WHEN l.event_id IS NOT NULL THEN 'lost ' || l.event_id WHEN f IS NOT NULL THEN 'an exception was thrown from the build' END AS message
FROM f LEFT JOIN m ON m.user_id = f.user_id LEFT JOIN l ON l.user_id = m.user_id AND l.n = m.n""")
def thrown_messages(spark, sf):
    """Each user's events as a log: named errors, frames of ours, and messages some of which stand near enough before the first frame."""
    k = F.col("event_id").cast("string")
    said = F.when(F.col("event_id") % 211 == 3, F.concat(F.lit("[err] broke "), k)).when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "I/flutter (7): #0  draw (package:made/view.dart:3)")
    said = said.when(F.col("event_id") % 17 == 1, F.concat(F.lit("I/flutter ( 7): lost "), k)).otherwise("D/other: x")
    lines = events(spark, sf).select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")).alias("n"), said.alias("line"))
    return spans.thrown(lines, "user_id", "n", "line", r"#0\s+.*\(package:made/view\.dart:\d+", r"\[err\]\s+(.*)$")

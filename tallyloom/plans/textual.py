"""Text queries: licences, patterns, digests, headers, failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordered
from ..sources.tables import events, read
from .registry import query

#: Phrases that must all occur for a licence.
SPDX = {"MIT": ("Permission is hereby granted", "MIT License"), "Apache-2.0": ("Apache License", "Version 2.0")}
CAUSES = [("network", r"socket|timeout"), ("auth", r"password|token|secret"), ("mail", r"[a-z0-9._]+@[a-z0-9.]+"), ("licence", r"licen[sc]e")]


@query("SCA08", """
WITH h AS (SELECT doc_id, contains(lower(text), 'permission is hereby granted') AND contains(lower(text), 'mit license') AS m, contains(lower(text), 'apache license') AND contains(lower(text), 'version 2.0') AS a FROM documents)
SELECT doc_id, CASE WHEN m AND NOT a THEN 'MIT' WHEN a AND NOT m THEN 'Apache-2.0' END AS spdx FROM h""")
def spdx_classify(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.spdx(F.col("text"), SPDX).alias("spdx"))


@query("SCA22 SCA30", """
SELECT CASE WHEN regexp_matches(text, '(?i)socket|timeout') THEN 'network' WHEN regexp_matches(text, '(?i)password|token|secret') THEN 'auth' WHEN regexp_matches(text, '(?i)[a-z0-9._]+@[a-z0-9.]+') THEN 'mail' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' ELSE 'other' END AS cause, count(*) AS n FROM documents GROUP BY 1""")
def failure_classify(spark, sf):
    return read(spark, sf, "documents").groupBy(T.first_match(F.col("text"), CAUSES, "other").alias("cause")).agg(F.count("*").alias("n"))


@query("FLT11", r"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '\blicense\b') THEN 'license' END, CASE WHEN regexp_matches(text, '\bthe\b') THEN 'the' END, CASE WHEN regexp_matches(text, '\bpassword\=') THEN 'password=' END], lambda x: x IS NOT NULL), ',') AS names FROM documents""")
def pattern_detect(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(T.detect(F.col("text"), ["license", "the", "password="]), ",").alias("names"))


@query("SCA05 WIN04", r"""
WITH h AS (SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'), chr(0))) AS d FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY d) AS lowest FROM h""")
def near_duplicate_lowest_id(spark, sf):
    """Every document of every language; a null text is empty."""
    return ordered.lowest_of_group(read(spark, sf, "documents").select("doc_id", T.normal_digest(F.coalesce("text", F.lit(""))).alias("d")), "d", "doc_id")


@query("FLT21", r"""
WITH t AS (SELECT page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') AS h FROM pages)
SELECT page_id, contains(h, '<script') AS script, contains(h, '<style') AS style, len(list_distinct(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)))::BIGINT AS tags FROM t""")
def forbidden_constructs(spark, sf):
    h = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    p = read(spark, sf, "pages").select("page_id", h.alias("h"))
    return p.select("page_id", F.contains("h", F.lit("<script")).alias("script"), F.contains("h", F.lit("<style")).alias("style"), F.size(F.array_distinct(F.regexp_extract_all("h", F.lit("<([a-z][a-z0-9]*)"), 1))).cast("long").alias("tags"))


@query("SCA01", r"""
WITH u AS (SELECT page_id, string_split(regexp_replace(regexp_replace(trim(url), '(\.git)?/*$', ''), '^[a-z]+://', ''), '/') AS p FROM pages)
SELECT page_id, lower(concat_ws('_', p[-2], p[-1])) AS repo_key FROM u""")
def repo_keys(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.repo_key(F.col("url")).alias("repo_key"))


@query("SCA09", r"""
WITH v AS (SELECT page_id, TRY_CAST(regexp_extract(url, '([0-9]+)', 1) AS INT) AS a FROM pages)
SELECT page_id, CASE WHEN a IS NOT NULL THEN (a > 2) OR (a = 2 AND 0 >= 12) END AS modern FROM v""")
def version_floor(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.version_at_least(F.col("url"), r"([0-9]+)()()", (2, 12, 0)).alias("modern"))


@query("SRC09 SRC10", r"""
WITH l AS (SELECT event_id, 'user=' || user_id || ' kind=' || event_type || ' value= ok=1' AS line FROM events)
SELECT event_id, TRY_CAST(regexp_extract(line, '(?:^|\s)user=(\S*)', 1) AS BIGINT) AS user_id, nullif(regexp_extract(line, '(?:^|\s)kind=(\S*)', 1), '') AS kind, nullif(regexp_extract(line, '(?:^|\s)value=(\S*)', 1), '') AS value, nullif(regexp_extract(line, '(?:^|\s)none=(\S*)', 1), '') AS none FROM l""")
def header_parse(spark, sf):
    line = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" kind="), F.col("event_type"), F.lit(" value= ok=1"))
    e = read(spark, sf, "events").select("event_id", line.alias("line"))
    f = lambda n: T.header_field(F.col("line"), n)
    return e.select("event_id", f("user").try_cast("long").alias("user_id"), f("kind").alias("kind"), f("value").alias("value"), f("none").alias("none"))


_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("FLT22", rf"""
SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) = trim(regexp_replace(replace(text, chr(10), ' '), '{_SPACE}', ' ', 'g')) AS no_op, length(text) <> length(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))) AS reformatted FROM documents""")
def no_op_edits(spark, sf):
    """Every document; no-break and other Unicode spaces are white space."""
    d = read(spark, sf, "documents")
    return d.select("doc_id", T.same_text(F.col("text"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("no_op"), (F.length("text") != F.length(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))).alias("reformatted"))


@query("FLT18", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, count(*) AS lines, min(pos) FILTER (contains(line, 'the')) AS first_hit, count(*) FILTER (contains(line, 'the')) AS hits FROM l GROUP BY 1""")
def line_scan(spark, sf):
    l = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)))  # noqa: E741
    hit = F.contains("col", F.lit("the"))
    return l.groupBy("doc_id").agg(F.count("*").alias("lines"), F.min(F.when(hit, F.col("pos").cast("long"))).alias("first_hit"), F.count_if(hit).alias("hits"))


@query("SCA02 SCA04 SCA07", """
SELECT conv_id, substr(sha256(string_agg(role || '::' || text, chr(0) ORDER BY turn)), 1, 16) AS digest FROM conversations GROUP BY 1""")
def content_digest(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("::", "role", "text").alias("t")))).alias("x"))
    return c.select("conv_id", F.substring(F.sha2(F.array_join("x.t", "\x00"), 256), 1, 16).alias("digest"))


@query("SCA14", """
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh%02dm', CAST(s // 3600 AS BIGINT), CAST(s % 3600 // 60 AS BIGINT)) WHEN s >= 60 THEN printf('%dm%02ds', CAST(s // 60 AS BIGINT), CAST(s % 60 AS BIGINT)) ELSE printf('%ds', CAST(s AS BIGINT)) END AS elapsed
FROM (SELECT event_id, (epoch_us(ts) // 1000000) % 10000 AS s FROM events)""")
def elapsed_format(spark, sf):
    s = F.col("s")
    e = events(spark, sf).select("event_id", (F.floor(F.col("us") / 1_000_000) % 10000).alias("s"))
    div = lambda a, b: F.floor(a / b).cast("long")
    return e.select("event_id", F.when(s >= 3600, F.format_string("%dh%02dm", div(s, 3600), div(s % 3600, 60))).when(s >= 60, F.format_string("%dm%02ds", div(s, 60), s % 60)).otherwise(F.format_string("%ds", s)).alias("elapsed"))


@query("ext name counts", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM documents)
SELECT name, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1""")
def name_facts(spark, sf):
    w = read(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), 1)).alias("name"))
    return w.groupBy("name").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("docs"))

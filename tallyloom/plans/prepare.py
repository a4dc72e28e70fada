"""Rounds of repositories: parts stand for repositories, their order lines for analyzer errors of numbered rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare
from ..sources.tables import read
from .registry import query

ROUNDS = 4

_ERRORS = """
e AS (SELECT l_partkey AS repo, CAST(l_linenumber AS BIGINT) AS round, l_suppkey % 9 AS f, l_suppkey % 13 AS p, (l_suppkey + l_orderkey) % 5 AS k, l_partkey % 6 AS kind FROM lineitem WHERE l_quantity > l_linenumber * (l_partkey % 5) * 5),
t AS (SELECT repo, round, 'lib/f' || f || CASE WHEN f = 3 AND kind < 2 THEN '.g.dart' ELSE '.dart' END AS file,
  CASE WHEN kind = 5 THEN 'syntax' WHEN kind = 4 THEN CASE WHEN k < 3 THEN 'uri_does_not_exist' ELSE 'syntax' END WHEN k = 0 THEN 'uri_does_not_exist' WHEN k = 1 THEN 'undefined_class' WHEN k = 2 THEN 'depend_on_referenced_packages' ELSE 'syntax' END AS code,
  CASE WHEN kind = 4 THEN 'no file ''package:app/absent' || p || '.dart''' WHEN kind = 1 AND p = 0 THEN 'package:flutter_gen/x' ELSE 'no file ''package:app/x' || p || '.dart''' END AS message FROM e)"""
#: The same rules as SQL: hints first, then what a failed import of the file explains, then paths without a commit.
_CAUSES = _ERRORS + """,
known AS (SELECT DISTINCT l_partkey AS repo, 'lib/x' || l_suppkey % 13 || '.dart' AS path FROM lineitem WHERE l_suppkey % 4 > 0),
m AS (SELECT t.*, max(CAST(code = 'uri_does_not_exist' AS INT)) OVER (PARTITION BY repo, round, file) AS failed, 'lib/' || regexp_extract(message, '''package:[a-zA-Z0-9_]+/([^'']+)''', 1) AS path FROM t),
c AS (SELECT m.repo, m.round, CASE WHEN contains(message, 'package:flutter_gen/') THEN 'obsolete_toolchain_api' WHEN regexp_matches(message, '\\.(g|freezed|config|gr|graphql)\\.dart') OR regexp_matches(file, '\\.(g|freezed|config|gr|graphql)\\.dart') THEN 'missing_codegen'
  WHEN code <> 'uri_does_not_exist' AND failed = 1 THEN NULL WHEN code = 'uri_does_not_exist' AND known.path IS NULL THEN 'missing_untracked_file' WHEN code IN ('uri_does_not_exist', 'depend_on_referenced_packages') THEN 'unresolved_dependency' WHEN code = 'undefined_class' THEN 'missing_codegen' ELSE 'broken_source' END AS cause
  FROM m LEFT JOIN known ON known.repo = m.repo AND known.path = m.path),
a AS (SELECT repo, round, """ + ", ".join(f"count(*) FILTER (cause = '{c}') AS {c}" for c in prepare.CAUSES) + ", count(*) AS errors FROM c GROUP BY 1, 2)"


def _errors(spark, sf):
    rows = read(spark, sf, "lineitem").filter(F.col("l_quantity") > F.col("l_linenumber") * (F.col("l_partkey") % 5) * 5)
    f, p, k, kind = F.col("l_suppkey") % 9, (F.col("l_suppkey") % 13).cast("string"), (F.col("l_suppkey") + F.col("l_orderkey")) % 5, F.col("l_partkey") % 6
    file = F.concat(F.lit("lib/f"), f.cast("string"), F.when((f == 3) & (kind < 2), ".g.dart").otherwise(".dart"))
    usual = F.when(k == 0, prepare.MISSING).when(k == 1, "undefined_class").when(k == 2, prepare.REFERENCED).otherwise("syntax")
    code = F.when(kind == 5, "syntax").when((kind == 4) & (k < 3), prepare.MISSING).when(kind == 4, "syntax").otherwise(usual)
    message = F.when(kind == 4, F.concat(F.lit("no file 'package:app/absent"), p, F.lit(".dart'"))).when((kind == 1) & (p == "0"), "package:flutter_gen/x").otherwise(F.concat(F.lit("no file 'package:app/x"), p, F.lit(".dart'")))
    return rows.select(F.col("l_partkey").alias("repo"), F.col("l_linenumber").cast("long").alias("round"), file.alias("file"), code.alias("code"), message.alias("message"))


def _committed(spark, sf):
    rows = read(spark, sf, "lineitem").filter("l_suppkey % 4 > 0")
    return rows.select(F.col("l_partkey").alias("repo"), F.concat(F.lit("lib/x"), (F.col("l_suppkey") % 13).cast("string"), F.lit(".dart")).alias("path"))


@query("AGG22", f"WITH {_CAUSES} SELECT repo, round, {', '.join(prepare.CAUSES)}, errors FROM a")
def error_causes(spark, sf):
    return prepare.attribute_errors(_errors(spark, sf), _committed(spark, sf), ["repo", "round"])


@query("RUL18", f"""
WITH RECURSIVE {_CAUSES},
r AS (SELECT p_partkey AS repo, g.round, p_partkey % 11 > 0 OR g.round < 2 AS ok FROM part, (SELECT unnest(range(1, {ROUNDS + 1})) AS round) g),
j AS (SELECT r.repo, r.round, ok, coalesce(errors, 0) AS errors, coalesce(missing_codegen, 0) + coalesce(unresolved_dependency, 0) AS mendable, coalesce(missing_untracked_file, 0) AS untracked FROM r LEFT JOIN a ON a.repo = r.repo AND a.round = r.round),
walk AS (
  SELECT repo, CAST(0 AS BIGINT) AS round, CAST(NULL AS BIGINT) AS errors, CAST(NULL AS VARCHAR) AS status FROM r WHERE round = 1
  UNION ALL
  SELECT j.repo, j.round, j.errors, CASE WHEN j.errors = 0 THEN 'clean' WHEN NOT ok THEN 'unsatisfiable_dependencies' WHEN mendable = 0 AND untracked > 0 THEN 'missing_untracked_file' WHEN mendable = 0 THEN 'broken_source'
    WHEN walk.errors = j.errors THEN 'no_progress' WHEN j.round = {ROUNDS} THEN 'exhausted_rounds' END
  FROM walk JOIN j ON j.repo = walk.repo AND j.round = walk.round + 1 WHERE walk.status IS NULL)
SELECT repo, status, round, CAST({ROUNDS} AS BIGINT) AS rounds FROM walk WHERE status IS NOT NULL""")
def round_verdicts(spark, sf):
    """Every part as a repository of four rounds; a round without error lines is a clean one."""
    causes = prepare.attribute_errors(_errors(spark, sf), _committed(spark, sf), ["repo", "round"])
    rounds = read(spark, sf, "part").select(F.col("p_partkey").alias("repo"), F.explode(F.expr(f"sequence(1L, {ROUNDS}L)")).alias("round"))
    rounds = rounds.withColumn("ok", (F.col("repo") % 11 > 0) | (F.col("round") < 2))
    every = rounds.join(causes, ["repo", "round"], "left").fillna(0, ["errors", *prepare.CAUSES])
    return prepare.round_verdicts(every, "repo", ROUNDS)

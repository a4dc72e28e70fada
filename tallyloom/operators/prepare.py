"""Preparing repositories: causes of analyzer errors and the verdict of a repository's rounds. Survey ids stand in brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks, codes and causes as analyzers and their readers know them.
RETIRED = "package:flutter_gen/"
GENERATED = r"\.(g|freezed|config|gr|graphql)\.dart|generated/l10n\.dart|/l10n/"
GENERATED_CODES = ("uri_has_not_been_generated", "undefined_class", "undefined_identifier")
MISSING, REFERENCED = "uri_does_not_exist", "depend_on_referenced_packages"
IMPORT = r"'package:[a-zA-Z0-9_]+/([^']+)'"
CAUSES = ("missing_codegen", "unresolved_dependency", "missing_untracked_file", "obsolete_toolchain_api", "broken_source")


def attribute_errors(errors: DataFrame, committed: DataFrame | None, keys: list[str]) -> DataFrame:
    """[AGG22] keys, one count for each of CAUSES, and errors, the count of all.

    errors: keys, file, code, message. An error counts once, by the first that holds: a retired package; a generated file in
    message or path; none, if its file has a failed import and it is no such import itself (its cause is counted there); a
    failed import of a path that no commit has; a failed import or an unlisted package; a name that generation would give;
    broken source. committed: keys[0] and path of every path that some commit has; without it no path is untracked. Null
    code, file and message are empty.

    Errors fold by file, cause and path before any exchange, so a file or message with most of the errors is no load; whether
    an error is downstream is settled on the sums of its file.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    code, file, message = text("code"), text("file"), text("message")
    first = F.when(F.contains(message, F.lit(RETIRED)), "obsolete_toolchain_api").when(message.rlike(GENERATED) | file.rlike(GENERATED), "missing_codegen")
    path = F.when(first.isNull() & (code == MISSING) & message.rlike(IMPORT), F.concat(F.lit("lib/"), F.regexp_extract(message, IMPORT, 1)))
    later = F.when(code.isin(MISSING, REFERENCED), "unresolved_dependency").when(code.isin(*GENERATED_CODES), "missing_codegen").otherwise("broken_source")
    own = errors.select(*keys, file.alias("file"), (code == MISSING).alias("failed"), first.isNotNull().alias("sure"), F.coalesce(first, later).alias("cause"), path.alias("path"))
    sums = own.groupBy(*keys, "file", "failed", "sure", "cause", "path").agg(F.count("*").alias("n"))
    if committed is not None:
        known = committed.select(keys[0], "path").distinct().withColumn("known", F.lit(True))
        sums = sums.join(known, [keys[0], "path"], "left")
        sums = sums.withColumn("cause", F.when(F.col("path").isNotNull() & F.col("known").isNull(), "missing_untracked_file").otherwise(F.col("cause")))
    n = lambda c, downstream: F.sum(F.when((F.col("cause") == c) & ((~F.col("sure") & ~F.col("failed")) == downstream), F.col("n")).otherwise(0))
    files = sums.groupBy(*keys, "file").agg(F.bool_or("failed").alias("failed"), F.sum("n").alias("errors"), *(n(c, d).alias(f"{c}_{d}") for c in CAUSES for d in (False, True)))
    counted = lambda c: F.col(f"{c}_False") + F.when(F.col("failed"), 0).otherwise(F.col(f"{c}_True"))
    return files.groupBy(*keys).agg(*(F.sum(counted(c)).alias(c) for c in CAUSES), F.sum("errors").alias("errors"))


def round_verdicts(rounds: DataFrame, repo: str, most: int) -> DataFrame:
    """[RUL18] repo, status, round, rounds: the first terminal state over a repository's rounds in order; later rounds are void.

    rounds: repo, round (from 1), ok (packages were resolved), errors, and the counts of CAUSES. A round is clean without
    errors; unsatisfiable_dependencies if packages were not resolved; missing_untracked_file or broken_source if nothing is left
    that another round could mend; no_progress if it has as many errors as the round before. exhausted_rounds at the last one
    of `most` that ends in none of these; rounds beyond `most` are not read, so a repository has a bounded number of rows.
    """
    left = F.col("missing_codegen") + F.col("unresolved_dependency")
    was = F.lag("errors").over(Window.partitionBy(repo).orderBy("round"))
    state = (
        F.when(F.col("errors") == 0, "clean")
        .when(~F.col("ok"), "unsatisfiable_dependencies")
        .when((left == 0) & (F.col("missing_untracked_file") > 0), "missing_untracked_file")
        .when(left == 0, "broken_source")
        .when(was == F.col("errors"), "no_progress")
    )
    seen = rounds.filter(F.col("round") <= most).withColumn("state", state)
    first = F.min(F.when(F.col("state").isNotNull(), F.col("round")))
    status = F.min_by("state", F.when(F.col("state").isNotNull(), F.col("round")))
    return seen.groupBy(repo).agg(F.coalesce(status, F.lit("exhausted_rounds")).alias("status"), F.coalesce(first, F.max("round")).alias("round"), F.count("*").alias("rounds"))

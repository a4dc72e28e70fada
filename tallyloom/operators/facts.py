"""Operators over landed source facts: scanners, value resolution, branches, shims, imports. Survey ids stand in brackets.

Facts that need a parser of the source language (RUL22-RUL25) arrive as rows; the engine decides on them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..sources.tables import cut


def top_level_parts(text: str, open_: str = "([{", close: str = ")]}", mark: str = ",") -> list[str]:
    """[SCA16, SCA17, SCA18] Parts between marks outside brackets and quoted strings, trimmed; an unclosed string ends the last part."""
    parts, depth, quote, start, skip = [], 0, "", 0, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            skip, quote = c == "\\", "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in open_:
            depth += 1
        elif c in close:
            depth -= 1
        elif c == mark and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [p for p in [*parts, text[start:].strip()] if p]


@F.pandas_udf(ArrayType(StringType()))
def split_top_level(s: pd.Series) -> pd.Series:
    """[SCA18] top_level_parts of each text; a null text has no parts."""
    return s.map(lambda t: top_level_parts(t) if isinstance(t, str) else [])


def literal(value: Column, kind: Column) -> Column:
    """[SCA19, RUL15] Source form of a JSON scalar: strings quoted and escaped, numbers and booleans as they are, null for other kinds."""
    quoted = F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(value.isNull(), "null").when(kind == "string", quoted).when(kind.isin("int", "double", "bool"), value)


def resolve(recovered: Column, policy: Column, enum: Column, collection: Column) -> Column:
    """[RUL15] struct(value, origin): recovered literal, then policy constant, first enum value, collection; else a refusal."""
    of = lambda v, o: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(o).alias("origin")))
    return F.coalesce(of(recovered, "recovered"), of(policy, "policy"), of(enum, "enum"), of(collection, "collection"), F.struct(F.lit(None).cast("string").alias("value"), F.lit("none").alias("origin")))


def branch_choice(branches: DataFrame, keys: list[str], then: str, other: str, unknown: str, lazy: str) -> DataFrame:
    """[RUL14, RUL21, RUL38, SCA25] Adds choice: the larger arm if it stays so with all unknown ones on the other side; none on a tie or a lazy arm."""
    a, b, u = F.col(then), F.col(other), F.coalesce(F.col(unknown), F.lit(0))
    return branches.withColumn("choice", F.when(a.isNull() & b.isNull(), "gates_nothing").when(F.col(lazy), "none").when(a >= b + u, F.when(a > b, "then").otherwise("none")).when(b >= a + u, "else").otherwise("none"))


def propagate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[RUL20] node, level: the largest level among a node and all that reach it by edges (src, node), until nothing changes.

    Rounds grow with the longest path; each is one join and one aggregation, written before the next.
    """
    while True:
        up = edges.join(nodes.select(F.col("node").alias("src"), F.col("level").alias("up")), "src").groupBy("node").agg(F.max("up").alias("up"))
        new = cut(nodes.join(up, "node", "left").select("node", F.col("level").alias("was"), F.greatest("level", "up").alias("level")))
        nodes = new.select("node", "level")
        if not new.filter("level > was").head(1):
            return nodes


def unfilled(bindings: DataFrame, key: str, origin: str, open_slots: str) -> DataFrame:
    """[R16, AGG29] key, fires, waiting: a group with an unresolved binding and a slot still open."""
    g = bindings.groupBy(key).agg(F.bool_or(F.col(origin) == "none").alias("none_"), F.sum(open_slots).alias("waiting"))
    return g.select(key, (F.coalesce("none_", F.lit(False)) & (F.col("waiting") > 0)).alias("fires"), "waiting")


def shim_drops(calls: DataFrame, constructors: DataFrame, key: str, name: str) -> DataFrame:
    """[R19, RUL23, RUL35] key, drops: calls that pass a child under a name their stand-in's constructors do not take.

    calls: key, name, param; constructors: name, params. A call without a constructor row has no stand-in.
    """
    hit = calls.join(constructors, name).filter(~F.array_contains("params", F.col("param")))
    return calls.select(key).distinct().join(hit.groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws(".", name, "param"))).alias("drops")), key, "left").select(key, F.coalesce("drops", F.array().cast("array<string>")).alias("drops"))


def pass_through(params: Column) -> Column:
    """[RUL35] The parameter that carries children: first of child, body, children."""
    return F.try_element_at(F.array_intersect(F.array(F.lit("child"), F.lit("body"), F.lit("children")), params), F.lit(1))


def region_seed(kind: Column, name: Column, returns: Column) -> Column:
    """[RUL32] Region of a member before propagation."""
    return F.when(name.isin("initState", "dispose", "didUpdateWidget", "didChangeDependencies"), "lifecycle").when((name == "build") | (returns == "Widget"), "rebuild").when(kind.isin("field", "constructor"), "lifecycle").when(name.rlike("^on[A-Z]"), "inert").otherwise("none")


def reaches_build(bindings: DataFrame, mounts: DataFrame) -> DataFrame:
    """[RUL37, JOI29] binding, reaches: used in the build itself, or mounted into a field that is. bindings: binding, direct; mounts: binding, field, field_used."""
    via = mounts.groupBy("binding").agg(F.bool_or("field_used").alias("via"))
    return bindings.join(via, "binding", "left").select("binding", (F.coalesce("direct", F.lit(False)) | F.coalesce("via", F.lit(False))).alias("reaches"))


def state_name(name: Column, taken: Column) -> Column:
    """[RUL39] _name, with State behind it where that is taken."""
    plain = F.concat(F.lit("_"), F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    return F.when(F.array_contains(taken, plain), F.concat(plain, F.lit("State"))).otherwise(plain)


def without_images(text: Column) -> Column:
    """[RUL27] Image calls of a known literal size as a grey box; others as one without a size."""
    sized = F.regexp_replace(text, r"Image\.(?:network|asset)\([^()]*?width:\s*([0-9.]+)[^()]*?height:\s*([0-9.]+)[^()]*\)", r"GreyBox($1, $2)")
    return F.regexp_replace(sized, r"Image\.(?:network|asset)\([^()]*\)", "GreyBox()")


def overlapping_edits(edits: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """[RUL31] Edits that begin before an earlier one of their file ends."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("e_", F.max(end).over(w)).filter(F.col("e_") > F.col(start)).drop("e_")


def adopt(authored: DataFrame, store: DataFrame, key: str, digest: str, names: str) -> DataFrame:
    """[INC26, INC28, INC30] key, action: new, same (equal digest), changed (both name sets known and unequal), else unknown."""
    s = store.select(key, F.col(digest).alias("d_"), F.col(names).alias("n_"), F.lit(True).alias("has_"))
    known = (F.size(F.coalesce(F.col(names), F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce("n_", F.array().cast("array<string>"))) > 0)
    action = F.when(F.col("has_").isNull(), "new").when(F.col(digest) == F.col("d_"), "same").when(known & (F.array_sort(names) != F.array_sort("n_")), "changed").otherwise("unknown")
    return authored.join(s, key, "left").select(key, action.alias("action"))

"""One fixture from the declarations of many roles, without an order in one task. Survey ids stand in brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def shape(text: Column | str) -> Column:
    """Source with runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def accepted_roles(declared: DataFrame, group: str, role: str) -> DataFrame:
    """[RUL16] group, role, accepted, clash, kind: roles in order of their names; one that contradicts what the accepted ones before it declare is dropped whole.

    declared: group, role, at (place in the role), name, header (null unless class-like), text, section. Two declarations of a name agree if
    their headers do, white space aside, or both have none and their texts do. A role that contradicts itself is dropped.
    clash is the first name, by place, that is at odds; kind is lifted_value if either side is of section lifted, else stand_in.

    Whatever is accepted of a name agrees, so a name has one form at most. Rounds settle roles until none is open: one is dropped by
    an accepted form before it that differs, and accepted where no open role before it has another form of any of its names.
    A round is aggregates by (group, name) and joins on it; no pairs of roles are made.
    """
    form = F.sha2(F.concat_ws("\0", F.when(F.col("header").isNotNull(), "class").otherwise("other"), shape(F.coalesce("header", "text"))), 256)
    rows = cut(declared.select(group, role, "at", "name", form.alias("form"), (F.col("section") == "lifted").alias("lifted")))
    own = rows.groupBy(group, role, "name").agg(F.min("form").alias("form"), F.count_distinct("form").alias("k"), F.bool_or("lifted").alias("lifted"))
    torn = own.groupBy(group, role).agg((F.max("k") > 1).alias("torn"))
    # state: null open, true accepted, false dropped
    state = cut(torn.select(group, role, F.when(F.col("torn"), False).alias("state")))
    facts = cut(own.select(group, role, "name", "form"))
    while state.filter("state IS NULL").limit(1).count():
        now = facts.join(state, [group, role])
        known = now.filter("state").groupBy(group, "name").agg(F.min(F.struct(role, "form")).alias("known"))
        first = now.filter("state IS NULL").groupBy(group, "name", "form").agg(F.min(role).alias("first"))
        best = first.withColumn("r", F.row_number().over(Window.partitionBy(group, "name").orderBy("first"))).filter("r <= 2")
        ahead = best.groupBy(group, "name").agg(F.min(F.when(F.col("r") == 1, F.struct("first", "form"))).alias("a"), F.min(F.when(F.col("r") == 2, F.struct("first", "form"))).alias("b"))
        seen = now.filter("state IS NULL").join(known, [group, "name"], "left").join(ahead, [group, "name"])
        other = F.when(F.col("a.form") != F.col("form"), F.col("a.first")).otherwise(F.col("b.first"))
        against = (F.col("known.form") != F.col("form")) & (F.col(f"known.{role}") < F.col(role))
        each = seen.groupBy(group, role).agg(F.bool_or(F.coalesce(against, F.lit(False))).alias("out"), F.bool_or(F.coalesce(other < F.col(role), F.lit(False))).alias("wait"))
        state = cut(state.join(each, [group, role], "left").select(group, role, F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("out"), False).when(~F.col("wait"), True).alias("state")))
    kept = own.join(state.filter("state"), [group, role]).groupBy(group, "name").agg(F.min(F.struct(F.col(role).alias("role"), "form", "lifted")).alias("w"))
    dropped = rows.join(state.filter("NOT state"), [group, role])
    # inside a role the first form of a name stands against later ones
    place = Window.partitionBy(group, role, "name").orderBy("at")
    inner = dropped.withColumns({"one": F.first("form").over(place), "lift": F.max("lifted").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    odd = inner.join(kept, [group, "name"], "left").filter(((F.col("w.form") != F.col("form")) & (F.col("w.role") < F.col(role))) | (F.col("one") != F.col("form")))
    kind = F.when(F.col("lift") | (F.coalesce(F.col("w.lifted"), F.lit(False)) & (F.col("w.role") < F.col(role))), "lifted_value").otherwise("stand_in")
    why = odd.groupBy(group, role).agg(F.min_by(F.struct(F.col("name").alias("clash"), kind.alias("kind")), "at").alias("y"))
    return state.join(why, [group, role], "left").select(group, role, F.col("state").alias("accepted"), "y.clash", "y.kind")


def registry(declared: DataFrame, accepted: DataFrame, members: DataFrame, group: str, role: str) -> DataFrame:
    """[RUL16, SET06] group, name, header, text, needs_value, members: what the accepted roles declare; a class has the longest text of each member, of equal ones the first.

    members: group, role, name, member, text. A name's header and text are those of the first role that declares it.
    """
    up = accepted.filter("accepted").select(group, role)
    first = F.min_by(F.struct("header", "text"), F.struct(role, "at"))
    names = declared.join(up, [group, role]).groupBy(group, "name").agg(first.alias("f"), F.bool_or("needs_value").alias("needs_value"))
    best = members.join(up, [group, role]).groupBy(group, "name", "member").agg(F.min_by("text", F.struct(-F.length("text"), role)).alias("text"))
    bodies = best.groupBy(group, "name").agg(F.array_sort(F.collect_list(F.struct("member", "text"))).alias("members"))
    return names.join(bodies, [group, "name"], "left").select(group, "name", "f.header", "f.text", "needs_value", "members")


def kept_imports(imports: DataFrame, used: DataFrame, exports: DataFrame) -> DataFrame:
    """[RUL26] file, uri, at, action: keep, drop (what it gives is given by others), fixed (as, show or hide) or unknown (no export table).

    imports: file, uri, at (place), how (plain, as, show, hide), names (shown or hidden). used: file, name. exports: uri, name, one row
    each. Plain imports count widest first, ties by place; one stays only if it is the first to give a name that the file uses and that
    no fixed import gives. A fixed import gives what it shows or does not hide; one under a prefix gives nothing. Unknown ones give nothing.

    The first giver of a name always stays, so a name is settled by one minimum and no order of imports runs in a task.
    """
    size = exports.groupBy("uri").agg(F.count("*").alias("size"))
    rows = imports.join(size, "uri", "left")
    action = F.when(F.col("size").isNull(), "unknown").when(F.col("how") != "plain", "fixed")
    rows = rows.withColumn("action", action)
    given = rows.filter("action IS DISTINCT FROM 'unknown' AND how <> 'as'").join(exports, "uri").join(used.distinct(), ["file", "name"])
    listed = F.array_contains(F.coalesce("names", F.array().cast("array<string>")), F.col("name"))
    given = given.filter(F.when(F.col("how") == "show", listed).when(F.col("how") == "hide", ~listed).otherwise(True))
    rank = F.struct((F.col("how") == "plain").alias("p"), F.when(F.col("how") == "plain", -F.col("size")).otherwise(0).alias("s"), "at")
    giver = given.groupBy("file", "name").agg(F.min_by(F.struct("uri", "at"), rank).alias("g"))
    needed = giver.select("file", F.col("g.uri").alias("uri"), F.col("g.at").alias("at")).distinct().withColumn("needed", F.lit(True))
    return rows.join(needed, ["file", "uri", "at"], "left").select("file", "uri", "at", F.coalesce("action", F.when(F.col("needed"), "keep").otherwise("drop")).alias("action"))


def audited(pairs: DataFrame, deltas: DataFrame, expected: DataFrame, tolerated: DataFrame) -> DataFrame:
    """[RUL13] pair, notes: what of a mutation does not go with its directive, in order; empty for a clean one.

    pairs: pair, directive, expect (slower, faster, neutral, stable or null), label (1 slower, 0 not, or null). deltas: pair, feature, delta. expected: directive,
    feature, sign. tolerated: directive, feature. A feature that is expected to move and does not, or the wrong way, is weak; one that
    moves and is neither expected nor tolerated is tangled; a directive without expectations is unknown; expect against the label is a disagreement.
    """
    known = expected.select("directive").distinct().withColumn("known", F.lit(True))
    weak = pairs.join(expected, "directive").join(deltas, ["pair", "feature"], "left").filter(F.coalesce("delta", F.lit(0)) * F.col("sign") <= 0)
    allowed = expected.select("directive", "feature").union(tolerated.select("directive", "feature")).distinct()
    tangled = deltas.filter("delta <> 0").join(pairs.select("pair", "directive"), "pair").join(allowed, ["directive", "feature"], "left_anti")
    says = F.when(F.lower("expect") == "slower", 1).when(F.lower("expect").isin("faster", "neutral", "stable"), 0)
    one = pairs.join(known, "directive", "left")
    note = lambda rows, kind, of=F.lit(""): rows.select("pair", F.concat(F.lit(kind), of).alias("note"))
    notes = note(weak, "weak ", F.col("feature")).unionByName(note(tangled, "tangled ", F.col("feature"))).unionByName(note(one.filter("known IS NULL"), "unknown directive")).unionByName(note(one.filter(says != F.col("label")), "label disagreement"))
    found = notes.groupBy("pair").agg(F.array_sort(F.collect_list("note")).alias("notes"))
    return pairs.select("pair").join(found, "pair", "left").select("pair", F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))

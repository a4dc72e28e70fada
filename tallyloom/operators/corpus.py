"""What may enter a corpus, stay in it, be overwritten or removed. Survey ids stand in brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(candidates: DataFrame, barred: list[DataFrame], url: str, normal, wanted: DataFrame | None = None) -> DataFrame:
    """[SRC26, JOI20] candidates whose normalised key is in none of `barred` and, if given, in `wanted`; all of those have the column url. A candidate without a key stays only where nothing is wanted.

    normal: Column to Column. Keys are compared after it on both sides, so spelling does not let one pass.
    """
    key = F.when(F.col(url).isNotNull(), normal(F.col(url)))
    rows = candidates.withColumn("key_", key)
    for b in barred:
        rows = rows.join(b.select(key.alias("key_")).filter("key_ IS NOT NULL").distinct(), "key_", "left_anti")
    if wanted is not None:
        rows = rows.join(wanted.select(key.alias("key_")).distinct(), "key_", "left_semi")
    return rows.drop("key_")


def placement(owned: Column, differs: Column, restorable: Column, present: Column, recorded: Column, new: Column) -> Column:
    """[RUL19, INC26] What becomes of a generated file: authored, restored, current or written.

    owned: the store holds a version that a person wrote for these roles; it is put back (restored) where the file differs and the
    store can. Else a file whose digest (`present`, null if there is none) is not the recorded one was edited: authored, never
    overwritten. A file as new says is current; anything else is written.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    mine = F.when(yes(differs) & yes(restorable), "restored").otherwise("authored")
    return F.when(yes(owned), mine).when(present.isNotNull() & ~present.eqNullSafe(recorded), "authored").when(present == new, "current").otherwise("written")


def stale(present: DataFrame, eligible: DataFrame, held: DataFrame, files: DataFrame, source: DataFrame, derived: list[str], force: bool = False) -> DataFrame:
    """[RUL10, SET08] group, action: remove or protect, for groups at the target that are neither eligible nor held.

    A group is protected by a file of its own that the source has not and that is not among derived: somebody wrote it, and it cannot be made
    again. force removes it all the same. files and source: group, name. Groups that stay are not returned.
    """
    gone = present.select("group").distinct().join(eligible.select("group"), "group", "left_anti").join(held.select("group"), "group", "left_anti")
    own = files.filter(~F.col("name").isin(derived)).join(source.select("group", "name"), ["group", "name"], "left_anti").select("group").distinct().withColumn("own", F.lit(True))
    return gone.join(own, "group", "left").select("group", F.when(F.col("own").isNotNull() & F.lit(not force), "protect").otherwise("remove").alias("action"))


def prune_stamp(roles: DataFrame, values: str, rules: str) -> DataFrame:
    """[INC30] One row: how many groups keep which endpoint roles (a digest of the sorted names of each), under which tables. roles: group, role."""
    own = roles.groupBy("group").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("role")), "\n"), 256).alias("d"))
    # order-free: sums of parts of the digests of groups
    part = lambda k: F.conv(F.substring(F.sha2(F.concat_ws("\0", F.col("group").cast("string"), "d"), 256), 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    return own.agg(F.count("*").alias("groups"), *(F.sum(part(k)).cast("string").alias(f"s{k}") for k in range(4))).select("groups", F.sha2(F.concat_ws(",", "s0", "s1", "s2", "s3"), 256).alias("roles"), F.lit(values).alias("values"), F.lit(rules).alias("rules"))


def refuse_pruned(stamp: DataFrame | None, tool: str) -> None:
    """[INC30, INC28] An error where a corpus carries a prune stamp, whatever it says: what is left decides nothing for the whole."""
    if stamp is not None and (found := stamp.head(1)):
        raise ValueError(f"{tool} needs every role, but the corpus was pruned to {found[0]['groups']} groups of endpoints")


def observed(table: DataFrame, fresh: DataFrame, keys: list[str], severity: Column, kept: list[str]) -> DataFrame:
    """[RUL11] The table after a survey: keys that it observed have its worst verdict, all others keep theirs.

    fresh may hold a key once for each device; the row of the highest severity counts, an error outranks nothing drawn, ties by the kept columns.
    """
    worst = fresh.groupBy(*keys).agg(F.max(F.struct(severity.alias("s_"), *kept)).alias("w_")).select(*keys, *(F.col(f"w_.{c}").alias(c) for c in kept))
    return table.select(*keys, *kept).join(worst.select(*keys), keys, "left_anti").unionByName(worst)


def until_accepted(df: DataFrame, keys: list[str], order: list[Column | str], accepted: Column, most: int) -> DataFrame:
    """[SRT07] Rows of each key in order, up to and with the one that is accepted as number `most`; what comes behind is never looked at."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("n_", F.coalesce(F.count_if(accepted).over(w), F.lit(0))).filter(F.col("n_") < most).drop("n_")


def moving(deltas: DataFrame, scope: str, feature: str, delta: str, share: float = 0.05, scopes: int = 3) -> DataFrame:
    """[FLT20] feature, pairs, moved, scopes of the features that move in at least `share` of their pairs and in at least `scopes` scopes. deltas: a row for each pair and feature."""
    moves = F.col(delta) != 0
    out = deltas.groupBy(feature).agg(F.count("*").alias("pairs"), F.count_if(moves).alias("moved"), F.count_distinct(F.when(moves, F.col(scope))).alias("scopes"))
    return out.filter((F.col("moved") >= share * F.col("pairs")) & (F.col("scopes") >= scopes))


def content(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """[INC10, MLE30] keys, rows, bytes and digest of what each key holds: sums of parts of row digests, so no order and no group in one task matters; a repeated row counts."""
    sha = F.sha2(F.coalesce(F.col(body), F.lit("")), 256)
    part = lambda k: F.conv(F.substring(sha, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    sums = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.coalesce(F.col(body), F.lit(""))).cast("long")).alias("bytes"), *(F.sum(part(k)).cast("string").alias(f"s{k}") for k in range(8)))
    return sums.select(*keys, "rows", "bytes", F.sha2(F.concat_ws(",", *(f"s{k}" for k in range(8))), 256).alias("digest"))


def rebuilt(baseline: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """[INC10, INC28] keys, verdict: same, or the first that differs of rows, bytes and digest; missing or new where one side lacks the key. Both sides are `content`."""
    a, b = (d.select(*keys, F.struct("rows", "bytes", "digest").alias(n)) for d, n in ((baseline, "a_"), (now, "b_")))
    differs = lambda c: ~F.col(f"a_.{c}").eqNullSafe(F.col(f"b_.{c}"))
    verdict = F.when(F.col("b_").isNull(), "missing").when(F.col("a_").isNull(), "new").when(differs("rows"), "rows").when(differs("bytes"), "bytes").when(differs("digest"), "digest").otherwise("same")
    return a.join(b, keys, "full").select(*keys, verdict.alias("verdict"))


def gate(sources: DataFrame, forbidden: dict[str, str], frozen: list[str], checked: list[str]) -> DataFrame:
    """[RUL12] id, violations: what a mutated source breaks, in the order of the checks; empty where it may stay.

    sources: id, base_<part> and made_<part> for every part of `frozen` (what must not change, white space aside; null is absent), base and
    made (whole texts), base_texts and made_texts (arrays of the strings shown), and a boolean for each of `checked`, what other
    tools found. A forbidden construct is looked for outside strings and comments; a made text equal to its base is none.
    """
    from .spans import COMMENT, STRING

    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    bare = F.regexp_replace("made", rf"{COMMENT}|{STRING}", " ")
    broken = [F.when(bare.rlike(pattern), f"forbidden {name}") for name, pattern in forbidden.items()]
    broken += [F.when(flat(f"made_{part}") != flat(f"base_{part}"), f"{part} changed") for part in frozen]
    broken.append(F.when(flat("made") == flat("base"), "no change"))
    shown = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    drift = F.concat(F.lit("texts +"), shown("made_texts", "base_texts"), F.lit(" -"), shown("base_texts", "made_texts"))
    broken.append(F.when(F.size(F.array_except("made_texts", "base_texts")) + F.size(F.array_except("base_texts", "made_texts")) > 0, drift))
    broken += [F.when(~F.coalesce(F.col(c), F.lit(False)), f"not {c}") for c in checked]
    return sources.select("id", F.array_compact(F.array(*broken)).alias("violations"))


def app_shape(entries: Column, settings: Column) -> Column:
    """[FLT10] Why a repository is no application of the wanted shape, by the first that holds: no settings, a plugin, no android folder, a desktop folder, a lower SDK bound under 2.12 or none; null if it is one.

    entries: names at the root. settings: text of its settings file, null if there is none. A bound is what follows sdk: with >= or ^.
    """
    from ..functions.text import version_at_least

    bound = version_at_least(settings, r"""sdk\s*:\s*["']?\s*(?:>=|\^)\s*(\d+)\.(\d+)(?:\.(\d+))?""", (2, 12, 0))
    desktop = F.arrays_overlap(entries, F.array(F.lit("linux"), F.lit("macos"), F.lit("windows")))
    plugin = F.contains(settings, F.lit("plugin:")) & F.contains(settings, F.lit("platforms:"))
    return F.when(settings.isNull(), "no settings").when(plugin, "plugin").when(~F.array_contains(entries, "android"), "no android").when(desktop, "desktop").when(~F.coalesce(bound, F.lit(False)), "sdk")


def with_history(fresh: DataFrame, prior: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """[JOI31, INC29] fresh with replaced, applied and overridden: what an override replaced, the first value recorded for good.

    fresh: keys, current, maximal. prior: keys, replaced, applied. committed: keys, value, as the last commit has it. What prior
    holds stays. Else, only where the current value is the maximal one, a committed value that differs is taken as the one replaced;
    a value that could not be decided (maximal null) is never filled in. Keys that fresh lacks go.
    """
    rows = fresh.join(prior.select(*keys, F.col("replaced").alias("was_"), F.col("applied").alias("how_")), keys, "left").join(committed.select(*keys, F.col("value").alias("head_")), keys, "left")
    fill = F.col("was_").isNull() & (F.col("current") == F.col("maximal")) & (F.col("head_") != F.col("current"))
    replaced = F.when(F.coalesce(fill, F.lit(False)), F.col("head_")).otherwise(F.col("was_"))
    applied = F.when(F.coalesce(fill, F.lit(False)), F.coalesce("how_", F.lit("backfilled"))).otherwise(F.col("how_"))
    return rows.select(*fresh.columns, replaced.alias("replaced"), applied.alias("applied"), replaced.isNotNull().alias("overridden"))


def claims(values: DataFrame, reported: DataFrame, name: str, tolerance: str) -> DataFrame:
    """[MLE28] name, value, reported, ok: figures worked out against figures reported, each within its tolerance. A claim without a figure is not ok."""
    rows = reported.select(name, F.col("reported"), F.col(tolerance).alias("t_")).join(values.select(name, "value"), name, "left")
    return rows.select(name, "value", "reported", F.coalesce(F.abs(F.col("value") - F.col("reported")) <= F.col("t_"), F.lit(False)).alias("ok"))

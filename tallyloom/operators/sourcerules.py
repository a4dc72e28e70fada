"""Rules on source facts and on the rows that describe a file. Survey ids stand in brackets.

Facts of a file are arrays: names, invoked, qualified, mixins, imports; those of code that a rebuild can reach stand again
in active_names, active_invoked, active_qualified, with the flags active_await and active_async. A missing array holds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of the rules.
ANIMATION = ["AnimationController", "Ticker", "TweenAnimationBuilder", "Hero", "vsync", "CircularProgressIndicator", "LinearProgressIndicator", "RefreshProgressIndicator"]
ANIMATED = [
    "AnimatedContainer", "AnimatedOpacity", "AnimatedAlign", "AnimatedPadding", "AnimatedPositioned", "AnimatedSwitcher", "AnimatedCrossFade", "AnimatedBuilder", "AnimatedDefaultTextStyle",
    "AnimatedSize", "AnimatedPhysical", "AnimatedTheme", "AnimatedList", "AnimatedIcon", "AnimatedRotation", "AnimatedScale", "AnimatedSlide",
]
ASYNC = ["StreamBuilder", "FutureBuilder", "Timer", "Future", "Stream"]
IO, IO_PREFIXES, IO_MADE = ["HttpClient", "Dio", "Socket", "rootBundle", "NetworkImage", "SharedPreferences"], ["WebView", "VideoPlayer", "AudioPlayer"], ["File", "Directory"]
KEEP_ALIVE = ["AutomaticKeepAliveClientMixin", "wantKeepAlive", "KeepAliveHandle"]
ROOTS, UNSTEADY = ["MaterialApp", "WidgetsApp", "CupertinoApp"], ["Stopwatch"]


def has(column: str, values: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values])), F.lit(False))


def some(column: str, test) -> Column:
    return F.coalesce(F.exists(column, test), F.lit(False))


def source_rules() -> dict[str, Column]:
    """[R1, R2, R3, R4, R5, R6] Rule name to predicate over a row of facts; R2 and R3 look at reachable code, but for the import."""
    starts = lambda prefixes: lambda n: reduce(lambda a, b: a | b, [F.startswith(n, F.lit(p)) for p in prefixes])
    return {
        "R1_animation": has("names", ANIMATION + ANIMATED) | some("names", lambda n: (F.length(n) > 10) & F.endswith(n, F.lit("Transition"))) | some("mixins", lambda m: F.contains(m, F.lit("TickerProvider"))),
        "R2_async": F.coalesce("active_await", F.lit(False)) | F.coalesce("active_async", F.lit(False)) | has("active_names", ASYNC),
        "R3_io_network": has("imports", ["dart:io"]) | has("active_names", IO) | some("active_names", starts(IO_PREFIXES)) | has("active_invoked", IO_MADE) | has("active_qualified", ["Image.network"]) | some("active_qualified", starts(["http."])),
        "R4_keepalive": has("names", KEEP_ALIVE) | has("mixins", KEEP_ALIVE),
        "R5_nested_app": has("names", ROOTS),
        "R6_nondeterminism": has("names", UNSTEADY) | has("qualified", ["DateTime.now"]) | has("invoked", ["Random"]),
    }


def row_rules() -> dict[str, Column]:
    """[R10, R11, R12, R14] Rules on a file's own row: verified, errors, source_resolved, reverted, truncated, closure. An absent flag is no verdict but for R14."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return {
        "R10_unverified": F.col("verified").isNotNull() & (~F.col("verified") | (F.coalesce("errors", F.lit(0)) > 0)),
        "R11_source_unresolved": F.col("source_resolved").eqNullSafe(F.lit(False)),
        "R12_inline_reverted": yes("reverted") | yes("truncated"),
        "R14_short_vector": ~F.col("closure").eqNullSafe(F.lit(1)),
    }


def package_licence(allowed: list[str]) -> Column:
    """[R17, JOI12] struct(kind, why) of a file with inlined package code: pass, disallowed or unattributed, two of the last kind apart.

    Columns: inlined, reverted, truncated, bytes_identical (null without a provenance row), packages (array of struct(name, spdx, readable)).
    """
    say = lambda kind, why: F.struct(F.lit(kind).alias("kind"), (F.lit(why) if isinstance(why, str) else why).alias("why"))
    first = lambda test: F.array_min(F.transform(F.filter("packages", test), lambda p: p["name"]))
    unread = first(lambda p: ~p["readable"])
    bad = F.array_sort(F.transform(F.filter("packages", lambda p: p["spdx"].isNull() | ~p["spdx"].isin(allowed)), lambda p: p["name"]))
    return (
        F.when((F.coalesce("inlined", F.lit(0)) == 0) | F.coalesce("reverted", F.lit(False)), say("pass", ""))
        .when(F.coalesce("truncated", F.lit(False)), say("unattributed", "truncated"))
        .when(F.col("bytes_identical").isNull(), say("unattributed", "no provenance"))
        .when(~F.col("bytes_identical"), say("unattributed", "another file"))
        .when(F.size(F.coalesce("packages", F.array().cast("array<struct<name:string,spdx:string,readable:boolean>>"))) == 0, say("unattributed", "no package"))
        .when(unread.isNotNull(), say("unattributed", F.concat(F.lit("unread "), unread)))
        .when(F.size(bad) > 0, say("disallowed", F.array_join(bad, ";")))
        .otherwise(say("pass", ""))
    )


def repo_licence(recorded: Column, seen: Column, aliases: dict[str, str], allowed: list[str]) -> Column:
    """[R18, JOI13, FLT08] Why a group goes for its repository's licence; null where it stays. No row at all counts as a violation."""
    spdx = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[F.lower(F.coalesce(recorded, F.lit("")))]
    return F.when(~seen, "unrecorded").when(spdx.isNull(), "unmapped").when(~spdx.isin(allowed), F.concat(F.lit("disallowed "), spdx))


def render_verdict(shot: Column, exception: Column, grey: Column, red: Column, flat: Column) -> Column:
    """[R21, R22] renders_error on an exception or an error colour, unknown without a picture, renders_nothing where one colour fills it."""
    return F.when(exception.isNotNull() | (shot & ((grey >= 0.02) | (red >= 0.02))), "renders_error").when(~shot, "unknown").when(flat >= 0.999, "renders_nothing").otherwise("renders")


def foreign_edits(source: Column, own: str = "own") -> Column:
    """[RUL28, RUL29, RUL30] Imports of foreign packages go as whole lines, icons of foreign fonts become a stand-in, custom font arguments go."""
    lines = F.filter(F.split(source, "\n"), lambda x: ~F.regexp_like(x, F.lit(r"^import 'package:")) | F.regexp_like(x, F.lit(rf"^import 'package:(flutter|{own})/")))
    text = F.regexp_replace(F.array_join(lines, "\n"), r"\bCupertinoIcons\.", "\x01.")
    text = F.replace(F.regexp_replace(text, r"\b[A-Z][A-Za-z]*Icons\.\w+", "Icons.circle"), F.lit("\x01."), F.lit("CupertinoIcons."))
    text = F.regexp_replace(text, r"fontFamily: '(serif|sans-serif|monospace)'", "fontFamily: \"$1\"")
    return F.replace(F.regexp_replace(text, r"fontFamily: '[^']*',? ?", ""), F.lit("fontFamily: \""), F.lit("fontFamily: \""))


def condition_arm(condition: Column, name: str) -> Column:
    """[SCA24] Which arm of a condition a set value takes: then, else, or unknown for anything but the plain forms."""
    c = F.trim(condition)
    return F.when(c.isin(name, f"{name} != null"), "then").when(c.isin(f"!{name}", f"{name} == null"), "else").when(F.regexp_like(c, F.lit(rf"^{name} == \S+$")), "then_if_equal").otherwise("unknown")


def since_epoch(value: Column, aliases: dict[str, str]) -> Column:
    """[SCA20] Seconds since 1970 of a date or of its alias; null for anything else."""
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.unix_date(F.coalesce(names[value], value).try_cast("date")).cast("long") * 86400


def required_versions(text: Column) -> Column:
    """[SCA30] Map from package to version in lines `<package> <x.y.z> is required`; the last line wins."""
    found = F.regexp_extract_all(text, F.lit(r"(\w+ \d+\.\d+\.\d+) is required"), 1)
    return F.aggregate(found, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != F.split(x, " ")[0]), F.create_map(F.split(x, " ")[0], F.split(x, " ")[1])))


def lock_version(text: Column, package: str) -> Column:
    """[SRC27] The version of a package in a lock file: blocks of two-space keys with deeper lines below."""
    return F.nullif(F.regexp_extract(text, rf'(?m)^  {package}:\n(?:    .*\n)*?    version: "([^"]+)"', 1), F.lit(""))


def commits(text: Column, suffix: str) -> Column:
    """[SRC22] array of struct(commit, at, subject, files) from NUL-separated blocks: a tab-separated head line, then names."""

    def one(block: Column) -> Column:
        lines = F.split(F.trim(block), "\n")
        head = F.split(lines[0], "\t", 4)
        return F.struct(head[0].alias("commit"), head[1].try_cast("long").alias("at"), F.substring(F.try_element_at(head, F.lit(4)), 1, 200).alias("subject"), F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.endswith(x, F.lit(suffix))).alias("files"))

    return F.transform(F.filter(F.split(text, "\x00"), lambda b: F.trim(b) != ""), one)


def diagnostics(text: Column) -> Column:
    """[SRC23] array of struct(severity, code, path) from both line layouts: `error|CODE|path` and `error - message - path - code`."""

    def one(line: Column) -> Column:
        at = lambda p, k: F.nullif(F.regexp_extract(line, p, k), F.lit(""))
        bars, dashes = r"^(error|warning)\|([A-Z_]+)\|(.+)$", r"^\s*(error|warning) - .* - (\S+) - (\w+)$"
        code = F.coalesce(F.lower(at(bars, 2)), at(dashes, 3))
        return F.struct(F.coalesce(at(bars, 1), at(dashes, 1)).alias("severity"), code.alias("code"), F.coalesce(at(bars, 3), at(dashes, 2)).alias("path"))

    return F.filter(F.transform(F.split(text, "\n"), one), lambda d: d["severity"].isNotNull())

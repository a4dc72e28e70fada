"""Text and key functions as columns. Survey ids stand in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repo_key(url: Column) -> Column:
    """[SCA01] The last two path parts, joined by _, in lower case."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.trim(url), r"(\.git)?/*$", ""), r"^[a-z]+://", ""), "/")
    return F.lower(F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))))


def spdx(text: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """[SCA08] The one licence all of whose phrases the text has; null for none or several."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(_all(F.contains(low, F.lit(p.lower())) for p in ps), name) for name, ps in phrases.items()]))
    return F.when(F.size(hits) == 1, hits[0])


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def first_match(text: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """[SCA22, AGG22] Name of the first pattern, in order, that occurs in any case."""
    out = F.lit(default)
    for name, p in reversed(patterns):
        out = F.when(F.regexp_like(text, F.lit("(?i)" + p)), name).otherwise(out)
    return out


def same_text(a: Column, b: Column) -> Column:
    """[FLT22] Equal but for white space, Unicode's included."""
    flat = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    return flat(a) == flat(b)


def detect(text: Column, names: list[str]) -> Column:
    """[FLT11] Names that occur as words, in the given order; an edge that is no word character needs no boundary."""
    word = lambda c: c.isalnum() or c == "_"
    escape = lambda n: "".join(c if word(c) else "\\" + c for c in n)
    pattern = lambda n: (r"\b" if word(n[0]) else "") + escape(n) + (r"\b" if word(n[-1]) else "")
    return F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(pattern(n))), n) for n in names]))


def version_at_least(text: Column, pattern: str, floor: tuple[int, int, int]) -> Column:
    """[SCA09, FLT10] Whether major.minor.patch in the text reaches the floor; null without a version."""
    at = lambda k: F.regexp_extract(text, pattern, k).try_cast("int")
    got = F.struct(at(1).alias("a"), F.coalesce(at(2), F.lit(0)).alias("b"), F.coalesce(at(3), F.lit(0)).alias("c"))
    return F.when(at(1).isNotNull(), got >= F.struct(*[F.lit(x).alias(n) for x, n in zip(floor, "abc", strict=True)]))


def header_field(line: Column, name: str) -> Column:
    """[SRC09, SRC10] Value of name=value anywhere in a line; null where it is absent or empty."""
    return F.nullif(F.regexp_extract(line, rf"(?:^|\s){name}=(\S*)", 1), F.lit(""))


def normal_digest(text: Column) -> Column:
    """[SCA05] sha256 of the word tokens in lower case, joined by NUL: equal for texts that differ in spacing and marks only. Letters of all scripts are words."""
    return F.sha2(F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1), "\x00"), 256)


def relation(added: Column, removed: Column) -> Column:
    """[SCA15, SET05] identical, added, removed or both."""
    a, r = F.size(added) > 0, F.size(removed) > 0
    return F.when(a & r, "both").when(a, "added").when(r, "removed").otherwise("identical")

"""Spans of text: innermost span of an offset, edits applied, brackets and initialisers, look-back in logs. Survey ids stand in brackets.

What one text gives (its tokens, edits, spans) is bounded by the text; nothing here gathers rows of several texts in one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: String literals: escapes, and interpolations with one level of braces and strings inside. Triple quotes come first.
_INSIDE = r"""\$\{(?:[^{}'"]|'[^']*'|"[^"]*"|\{[^{}]*\})*\}"""
STRING = "|".join([r"r'''[\s\S]*?'''", r'r"""[\s\S]*?"""', r"r'[^']*'", r'r"[^"]*"'] + [rf"{q}{{3}}(?:\\[\s\S]|{_INSIDE}|(?!{q}{{3}})[^\\])*{q}{{3}}|{q}(?:\\[\s\S]|{_INSIDE}|[^\\{q}])*{q}" for q in ("'", '"')])
COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
#: One token each: comment, string, a raw prefix that starts no string, white space, bracket, mark, anything else in runs.
TOKEN = rf"""(?:{COMMENT}|{STRING}|\s+|[()\[\]{{}};]|[^\s()\[\]{{}};'"/r]+|[\s\S])"""


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, kind: str, above: str | None = None) -> DataFrame:
    """[RUL34] points with region: the `kind` of the innermost span of their key that holds `at` (start <= at < end), null where none does.

    spans: key, start, end (from 0), kind. Innermost is the span that starts last, then ends first, then is least by kind. From
    the first start of a span of kind `above` on, that kind outranks all others. Empty spans hold nothing; a point without a
    key or offset lies in none.

    A span is tiled by aligned blocks of powers of two, at most two of a size, and a point looks up its block of each size, so
    the join is by equality and makes one row for each span that holds the point. Equal points look up once.
    """
    probes = points.select(F.col(key), F.col(at).alias("at_")).filter(F.col(key).isNotNull() & F.col("at_").isNotNull()).distinct()
    own = spans.select(F.col(key), F.col("start").cast("long").alias("s_"), F.col("end").cast("long").alias("e_"), F.col(kind).alias("k_"))
    own = own.withColumn("first_", F.lit(0))
    if above is not None:
        last = points.agg((F.max(at) + 1).cast("long").alias("e_"))
        rest = own.filter((F.col("k_") == above) & (F.col("s_") < F.col("e_"))).groupBy(key).agg(F.min("s_").alias("s_"))
        own = own.unionByName(rest.crossJoin(F.broadcast(last)).select(key, "s_", "e_", F.lit(above).alias("k_"), F.lit(1).alias("first_")))
    own = own.filter(F.col("s_") < F.col("e_"))
    longest = own.agg(F.max(F.col("e_") - F.col("s_"))).first()[0] or 1
    sizes = F.explode(F.sequence(F.lit(0), F.lit(longest.bit_length())))
    tiled = own.withColumn("l_", sizes).withColumns({"a_": F.expr("shiftright(s_ + shiftleft(1L, l_) - 1, l_)"), "z_": F.expr("shiftright(e_, l_)")}).filter("a_ < z_")
    # a block whose pair lies outside is used at this size; all others go up into larger ones
    edges = F.array_compact(F.array(F.when(F.col("a_") % 2 == 1, F.col("a_")), F.when(F.col("z_") % 2 == 1, F.col("z_") - 1)))
    blocks = tiled.select(key, "s_", "e_", "k_", "first_", "l_", F.explode(edges).alias("b_"))
    looked = probes.withColumn("l_", sizes).withColumn("b_", F.expr("shiftright(cast(at_ as long), l_)"))
    best = F.min_by("k_", F.struct(-F.col("first_"), -F.col("s_"), F.col("e_"), F.col("k_")))
    found = looked.join(blocks, [key, "l_", "b_"]).groupBy(key, "at_").agg(best.alias("region"))
    return points.join(found.withColumnRenamed("at_", at), [key, at], "left")


def find_edits(texts: DataFrame, key: str, text: str, pattern: str, keep: Callable[[Column], Column] = lambda found: found) -> DataFrame:
    """key, start, end, found: matches of a pattern (without groups, never empty) from left to right, offsets in UTF-8 bytes.

    Rows meet by key with the lengths of matches; what `keep` makes of a match goes along only where it is used.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"))
    rows = texts.select(key, F.posexplode(parts).alias("i_", "p_")).select(key, "i_", F.octet_length("p_.gap").alias("g_"), F.octet_length("p_.found").alias("n_"), keep(F.col("p_.found")).alias("found"))
    upto = F.sum(F.col("g_") + F.coalesce("n_", F.lit(0))).over(Window.partitionBy(key).orderBy("i_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", upto).filter("n_ IS NOT NULL").select(key, (F.col("end") - F.col("n_")).alias("start"), "end", "found")


def apply_edits(texts: DataFrame, edits: DataFrame, key: str, text: str, kinds: list[str]) -> DataFrame:
    """[RUL31] texts with rewritten and n_<kind> for each of kinds: every edit's bytes [start, end) replaced, all others kept.

    edits: key, start, end (UTF-8 bytes from 0), replacement, kind. Edits that overlap, end before their start or leave the text
    raise an error; insertions (start = end) are applied in order of (end, kind, replacement). A text without edits stays;
    a null text stays null; edits without a text go nowhere. Keys of texts are unique.

    The result is one ordered list of kept and new pieces joined once: linear in the text, whatever the number of edits.
    """
    e = F.struct("start", "end", "kind", "replacement")
    own = edits.groupBy(key).agg(F.array_sort(F.collect_list(e)).alias("e_"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
    rows = texts.join(own, key, "left").withColumn("b_", F.encode(text, "UTF-8")).withColumn("e_", F.coalesce("e_", F.array().cast(own.schema["e_"].dataType)))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("e_", i - 1)["end"])
    bad = F.exists(F.transform("e_", lambda x, i: (x["start"] < before(i)) | (x["end"] < x["start"]) | (x["end"] > F.octet_length(text))), lambda x: x)
    kept = lambda a, n: F.decode(F.substring("b_", (a + 1).cast("int"), n.cast("int")), "UTF-8")
    pieces = F.transform("e_", lambda x, i: F.concat(kept(before(i), x["start"] - before(i)), F.coalesce(x["replacement"], F.lit(""))))
    last = F.when(F.size("e_") > 0, F.get("e_", F.size("e_") - 1)["end"]).otherwise(F.lit(0))
    whole = F.concat(F.array_join(pieces, ""), kept(last, F.octet_length(text) - last))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("overlapping or outlying edits of "), F.col(key).cast("string")))).otherwise(whole)
    out = rows.withColumn("rewritten", checked)
    return out.withColumns({f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in kinds}).drop("b_", "e_")


def _tokens(texts: DataFrame, key: str, text: Column, pattern: str, opens: str, closes: str) -> DataFrame:
    """key, i_, t_, depth: tokens in order and the brackets open behind each, by a running sum."""
    rows = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).alias("i_", "t_"))
    step = F.when(F.col("t_").isin(*opens), 1).when(F.col("t_").isin(*closes), -1).otherwise(0)
    return rows.withColumn("depth", F.sum(step).over(Window.partitionBy(key).orderBy("i_").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _until(rows: DataFrame, key: str, stop: Column) -> DataFrame:
    """rows up to the first where `stop` holds, that one with stop_; a key without one goes."""
    ends = F.min(F.when(F.col("stop_"), F.col("i_"))).over(Window.partitionBy(key))
    return rows.withColumn("stop_", stop).withColumn("z_", ends).filter(F.col("i_") <= F.col("z_"))


def _joined(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i_", "t_"))), lambda x: x["t_"]), "").alias(name))


def brace_block(texts: DataFrame, key: str, text: str, mark: str, strings: bool = False) -> DataFrame:
    """[SCA16] texts with block: from the first brace at or behind the end of the first match of `mark` to the brace that closes it; null without either.

    `mark` may itself end with the opening brace. Braces in strings and comments count as any other, unless `strings` asks to
    pass over both. Keys are unique. Depth is a running sum over the tokens of a text.
    """
    # what stands before the opening brace goes; a brace that ends the mark is kept. The mark is looked for once
    found = texts.select(key, F.col(text).alias("text_"), F.regexp_extract(text, rf"^([\s\S]*?(?:{mark}))", 1).alias("after_"))
    after = F.col("after_")
    rest = F.when((after != "") | F.col("text_").rlike(mark), F.substring("text_", F.length(after) + F.when(F.endswith(after, F.lit("{")), 0).otherwise(1), F.length("text_")))
    pattern = rf"{COMMENT}|{STRING}|[{{}}]|[^{{}}'\"/r]+|[\s\S]" if strings else r"[{}]|[^{}]+"
    rows = _tokens(found, key, rest, pattern, "{", "}")
    # tokens before the first opening brace have depth 0 or less
    first = F.min(F.when(F.col("t_") == "{", F.col("i_"))).over(Window.partitionBy(key))
    base = rows.withColumn("a_", first).filter("i_ >= a_")
    start = F.first("depth").over(Window.partitionBy(key).orderBy("i_"))
    base = base.withColumn("level_", start)
    block = _joined(_until(base, key, (F.col("t_") == "}") & (F.col("depth") == F.col("level_") - 1)), key, "block")
    return texts.join(block, key, "left")


def initialiser(texts: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """[SCA17, SCA18] texts with init: what is assigned to the first `name` =, up to its own semicolon; null if the text runs out, a bracket closes that is not its own, or nothing stands there.

    name is a pattern. Brackets nest; a semicolon or bracket in a string or comment is text. Comments go, runs of white space outside
    strings become one space. A string or comment that does not end takes the initialiser with it.
    """
    rest = F.when(F.col(text).rlike(rf"{name}\s*="), F.regexp_replace(text, rf"^[\s\S]*?{name}\s*=", ""))
    rows = _tokens(texts, key, rest, TOKEN, "([{", ")]}")
    broken = F.col("t_").isin("'", '"') | (F.col("depth") < 0)
    cut = _until(rows, key, ((F.col("t_") == ";") & (F.col("depth") == 0)) | broken)
    fine = cut.groupBy(key).agg(F.max_by("t_", "i_").alias("stop_t")).filter("stop_t = ';'").select(key)
    code = cut.filter(~F.col("stop_") & ~F.col("t_").rlike(r"^(//|/\*)")).join(fine, key, "left_semi")
    blank = F.col("t_").rlike(r"^\s+$")
    was = F.lag(blank).over(Window.partitionBy(key).orderBy("i_"))
    code = code.withColumns({"was_": was, "t_": F.when(blank, " ").otherwise(F.col("t_"))}).filter(~((F.col("t_") == " ") & F.coalesce("was_", F.lit(True))))
    out = _joined(code, key, "init").withColumn("init", F.rtrim("init")).filter("init <> ''")
    return texts.join(out, key, "left")


def thrown(lines: DataFrame, key: str, at: str, line: str, frame: str, named: str, back: int = 39) -> DataFrame:
    """[SCA23] key, message for each key of lines: what its log says was thrown from a frame of ours; null without one.

    A line whose first group of the pattern `named` is no frame names it: the first such counts. Else the first line that matches `frame` is
    taken, and of the lines up to `back` before it the nearest of the tag flutter that is neither empty nor a frame; if none
    is that near, a general message. Line numbers are unique in a key.

    Marks and the first frame are aggregates; only the lines at that frame are looked at again, by (key, cell of line numbers).
    """
    name = F.trim(F.regexp_extract(line, named, 1))
    told = F.regexp_extract(F.trim(line), r"^[A-Z]/flutter\s*\(\s*\d+\):\s?(.*)$", 1)
    trace = r"^#\d+\s"
    rows = lines.select(
        key,
        F.col(at).cast("long").alias("n_"),
        F.when((name != "") & ~name.rlike(trace), name).alias("named_"),
        F.when((told != "") & ~told.rlike(trace), F.trim(told)).alias("told_"),
        F.col(line).rlike(frame).alias("frame_"),
    )
    first = rows.groupBy(key).agg(F.min_by("named_", F.when(F.col("named_").isNotNull(), F.col("n_"))).alias("named"), F.min(F.when(F.col("frame_"), F.col("n_"))).alias("f_"))
    cell = lambda c: F.floor(c / (back + 1)).cast("long")
    near = first.filter("named IS NULL AND f_ IS NOT NULL").select(key, "f_", F.explode(F.array_distinct(F.array(cell(F.col("f_") - back), cell(F.col("f_"))))).alias("c_"))
    hits = rows.filter("told_ IS NOT NULL").withColumn("c_", cell(F.col("n_"))).join(near, [key, "c_"]).filter((F.col("n_") < F.col("f_")) & (F.col("n_") >= F.col("f_") - back))
    said = hits.groupBy(key).agg(F.max_by("told_", "n_").alias("said"))
    general = F.when(F.col("f_").isNotNull(), "an exception was thrown from the build")
    return first.join(said, key, "left").select(key, F.coalesce("named", "said", general).alias("message"))

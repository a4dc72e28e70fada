"""Chat formatting (7), native: render turns, parse the result again, escape until both agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

END = "</turn>\n"
#: Codes of the escape: every backslash in an escaped text starts one, so the way back is unique.
CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(x: Column) -> Column:
    for raw, code in CODES:
        x = F.replace(x, F.lit(raw), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for raw, code in reversed(CODES):
        x = F.replace(x, F.lit(code), F.lit(raw))
    return x


def label(role: Column) -> Column:
    """System, User, Assistant; any other role, the empty one too, as = and its escaped name."""
    return F.when(role.isin("system", "user", "assistant"), F.initcap(role)).otherwise(F.concat(F.lit("="), escape(role)))


def segment(role: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), label(role), F.lit(": "), body, F.lit(END))


def read_segment(seg: Column) -> Column:
    """The turn of one segment without its end mark; null where the grammar rejects it.

    segment = "### " label ": " body; a label holds no colon, a body holds neither "###" nor "</turn>".
    """
    at = F.locate(":", seg)
    name, body = F.substring(seg, F.lit(5), at - 5), F.substring(seg, at + 2, F.length(seg))
    role = F.when(F.startswith(name, F.lit("=")), unescape(F.substring(name, F.lit(2), F.length(name)))).when(name.isin("System", "User", "Assistant"), F.lower(name))
    fits = F.startswith(seg, F.lit("### ")) & (at > 0) & role.isNotNull() & ~F.contains(body, F.lit("###")) & ~F.contains(body, F.lit("</turn>"))
    return F.when(fits, F.struct(role.alias("role"), unescape(body).alias("text")))


def read_back(formatted: Column) -> Column:
    """The turns of a whole rendered conversation."""
    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), read_segment)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (start from 0 and length, in code points), turns (read back from formatted).

    Null texts and roles are empty ones; a null conv_id is a conversation of its own. Turns sort by turn (nulls first),
    role, text; repeated rows are repeated turns. A turn is rendered as it stands, parsed, and escaped if the parser does
    not return it. The whole rendering is parsed once more and must give the source, else the job fails. The end mark
    cannot overlap itself, so turns that parse alone parse together. Rendering runs before the exchange.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    plain = F.split(segment(F.col("role"), F.col("text")), END, -1)
    same = (F.size(plain) == 2) & read_segment(plain[0]).eqNullSafe(F.struct("role", "text"))
    turns = turns.withColumn("body", F.when(same, F.col("text")).otherwise(escape(F.col("text"))))
    turns = turns.withColumn("seg", segment(F.col("role"), F.col("body")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(F.length("seg")).over(before), F.lit(0)))
    row = F.struct("at", "role", "text", "seg", (F.col("at") + F.length("seg") - F.length(F.lit(END)) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    out = whole.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.col("t.seg"), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    ).withColumn("turns", read_back(F.col("formatted")))
    checked = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not read back")))
    return out.select("conv_id", "n_turns", "formatted", "loss_spans", checked.alias("turns"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, cut from formatted and unescaped; a body rendered as it stands holds no code, so it comes back too."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = format_chats(rows.unionByName(more))
    own = loss_text(F.col("formatted"), F.col("loss_spans"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(own).cast("long").alias("loss_chars"), F.sha2(own, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_ESC = "replace(replace(replace(replace({0}, '\\', '\\b'), '#', '\\h'), '<', '\\l'), ':', '\\c')"
_ODD = "contains({0}, '###') OR contains({0}, '</turn>') OR contains({0}, '\\b') OR contains({0}, '\\h') OR contains({0}, '\\l') OR contains({0}, '\\c')"
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), s AS (
  SELECT *, CASE WHEN {_ODD.format("text")} THEN {_ESC.format("text")} ELSE text END AS body,
         CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE '=' || {_ESC.format("role")} END AS label FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(label) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

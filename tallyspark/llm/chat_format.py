"""Chat formatting with a grammar round trip, by DataFrame functions alone.

Template: ``<s>text</s>`` for an assistant turn, ``[INST] role\\ntext [/INST]`` for any other.  Texts are first rendered as
they are; the rendered string is read back by a deterministic parser, and where the recovered turns differ from the
source, conflicting content is escaped and the result parsed again (``exact`` says whether the turns came back; a
conversation that didn't would have it false, and none is known).  Escaping puts one backslash behind the first character of each control string, also where backslashes
already stand there, and unescaping takes one away, so any text survives; roles use percent signs.

Defined results: a null text or role is empty; rows of a conversation go by turn, then role and text, and repeated rows
stay; a null conv_id is a conversation; an empty table gives an empty table; other columns are left out.  A conversation
is one string, so the rows of one conversation meet in one task, as its output does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
_TURN = "array<struct<role:string,text:string>>"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"$1\\$2$3")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3")


def _escape_role(c: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("[", "%5B"), ("<", "%3C")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _unescape_role(c: Column) -> Column:
    for a, b in (("%3C", "<"), ("%5B", "["), ("%0A", "\n"), ("%25", "%")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def render(turns: Column, escaped: bool) -> Column:
    """The formatted string of an array of (role, text)."""
    text = escape_text if escaped else (lambda c: c)
    role = _escape_role if escaped else (lambda c: c)
    return F.concat_ws("", F.transform(turns, lambda t: F.when(t["role"] == "assistant", F.concat(F.lit("<s>"), text(t["text"]), F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST] "), role(t["role"]), F.lit("\n"), text(t["text"]), F.lit(" [/INST]")))))


def segments(formatted: Column) -> Column:
    """The raw turns of a formatted string: cut before every opening control string."""
    return F.when(formatted == "", F.array().cast("array<string>")).otherwise(F.split(formatted, r"(?=\[INST\] |<s>)"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted string; a turn that breaks the grammar becomes null."""

    def turn(s: Column) -> Column:
        n, line = F.length(s), F.locate("\n", s)
        assistant = F.struct(F.lit("assistant").alias("role"), unescape_text(F.substring(s, F.lit(4), n - 7)).alias("text"))
        other = F.struct(_unescape_role(F.substring(s, F.lit(8), line - 8)).alias("role"), unescape_text(F.substring(s, line + 1, n - line - 8)).alias("text"))
        # a closing control string stands at the end and nowhere else
        return F.when(s.startswith("<s>") & (F.locate("</s>", s) == n - 3), assistant).when(
            s.startswith("[INST] ") & (line > 0) & (F.locate(" [/INST]", s) == n - 7), other)

    return F.transform(segments(formatted), turn)


def loss_spans(formatted: Column) -> Column:
    """(start, length) in code points, from 0, of every assistant text in the formatted string."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct((acc["at"] + 3).alias("start"), (F.length(s) - 7).alias("length"))
        return F.struct((acc["at"] + F.length(s)).alias("at"), F.when(s.startswith("<s>"), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments(formatted), empty, step, lambda a: a["spans"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (as given), formatted, escaped (whether escaping was needed), parsed (read back), loss_spans, exact."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), role.alias("role"), text.alias("text")))).alias("rows"))
    chats = chats.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))
    plain = chats.withColumn("_plain", render(F.col("turns"), False)).withColumn("escaped", ~parse(F.col("_plain")).cast(_TURN).eqNullSafe(F.col("turns")))
    out = plain.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("_plain"))).withColumn("parsed", parse(F.col("formatted")).cast(_TURN))
    same = F.col("parsed").eqNullSafe(F.col("turns"))
    return out.select("conv_id", "turns", "formatted", "escaped", "parsed", loss_spans(F.col("formatted")).alias("loss_spans"), same.alias("exact"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape_text(F.substring(formatted, s["start"] + 1, s["length"]))))

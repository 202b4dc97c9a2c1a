"""Chat formatting with prefix-target expansion.

A conversation is written once as

    <turn>role<text>text</turn><turn>role<text>...

with ``\\`` as ``\\b`` and ``<`` as ``\\l`` inside roles and texts, so no
text can hold a control string and the output reads back exactly. Every
assistant turn is an example of its own: its context is the formatted
string up to the reply (all preceding turns), and only the reply is
trainable. Examples are kept as code-point spans of the one formatted
string, so the output is linear in the conversation although contexts
overlap; ``examples`` explodes them, ``materialised`` writes the prompt
and the target out.

Rows are ordered by turn (null first), ties by role and text; null role
and text are empty; rows that repeat are kept; a null conv_id is a
conversation of its own; other columns are ignored; an empty table gives no
rows. One conversation is one string and thus one row, as its digest asks;
one shuffle by conv_id, and one more of the replies where the exploded
examples are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
TRAINED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, examples): one row per conversation; examples
    is an array of (target_start, target_len), the trainable spans."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("conv_id"),
                        F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"),
                                 text(text_col).alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("reply"),
        (t["role"] == TRAINED).alias("trained")))
    convs = convs.select("conv_id", parts.alias("parts"))
    size = lambda p: F.length(p["head"]) + F.length(p["reply"]) + F.lit(len(END))
    # fold over the turns: (code points so far, spans so far)
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<target_start:int,target_len:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + size(p)).alias("at"),
            F.when(p["trained"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("target_start"),
                F.length(p["reply"]).alias("target_len"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["reply"], F.lit(END))), "")
    return convs.select("conv_id", formatted.alias("formatted"), spans.alias("examples"))


def examples(convs: DataFrame) -> DataFrame:
    """One row per assistant turn: the context ends where its target starts."""
    return convs.select("conv_id", F.posexplode("examples").alias("example", "span")).select(
        "conv_id", "example", "span.target_start", "span.target_len")


def materialised(convs: DataFrame) -> DataFrame:
    """Examples with their texts: (conv_id, example, context, target)."""
    span = convs.select("conv_id", "formatted", F.posexplode("examples").alias("example", "span"))
    return span.select("conv_id", "example",
                       F.substring(F.col("formatted"), F.lit(1), F.col("span.target_start")).alias("context"),
                       F.substring(F.col("formatted"), F.col("span.target_start") + 1,
                                   F.col("span.target_len")).alias("target"))


def read_back(convs: DataFrame) -> DataFrame:
    """(conv_id, turns, targets): roles and texts parsed from the formatted
    strings, and the unescaped texts under the loss mask."""
    grab = lambda group: F.regexp_extract_all(
        F.col("formatted"), F.lit("(?s)<turn>([^<]*+)<text>([^<]*+)</turn>"), F.lit(group))
    turns = F.zip_with(grab(1), grab(2), lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    targets = F.transform("examples", lambda e: unescape(
        F.substring(F.col("formatted"), e["target_start"] + 1, e["target_len"])))
    return convs.select("conv_id", "formatted", turns.alias("turns"), targets.alias("targets"))


def expanded(convs: DataFrame) -> DataFrame:
    """``read_back`` with targets from the exploded examples: every assistant
    turn is a row of its own, and a conversation's replies are gathered from
    these rows again, in order."""
    rows = materialised(convs).groupBy(F.col("conv_id").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("example", "target"))).alias("examples"))
    back = read_back(convs).drop("targets").join(rows, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    targets = F.coalesce(F.transform("examples", lambda e: unescape(e["target"])), F.array().cast("array<string>"))
    return back.select("conv_id", "formatted", "turns", targets.alias("targets"))


def digests(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))

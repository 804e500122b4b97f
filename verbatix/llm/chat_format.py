"""Chat formatting: prefix-target expansion.

Every assistant turn of a conversation becomes one example: all turns before it are its context,
and its own text is the only part under the loss mask. Turns that follow the last reply are kept in
one closing example without a loss span, so that the examples hold the whole conversation.

Template: each turn is ``### <role>: <text></turn>\\n``. Inside roles and texts a backslash is written
``\\b``; the control strings ``### `` and ``</turn>`` are broken up by ``\\e``; in roles a colon is
``\\c``. Neither control string can therefore occur inside a turn, and reading back is exact.

Defined results: a null role or text is the empty string; a null ``turn`` comes before all numbers;
equal ``turn`` values are ordered by role, then text; repeated rows are repeated turns; every row with a
null ``conv_id`` is a conversation of its own, told from others by ``talk``; a conversation without replies has only the closing example;
an empty table has no examples; other columns are ignored. An example is one row, so a conversation
is bound by the size of a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, SEPARATOR = "### ", "</turn>", ": "


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.replace(text, F.lit(OPEN), F.lit("###\\e "))
    return F.replace(text, F.lit(CLOSE), F.lit("</turn\\e>"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\c"), F.lit(":")), F.lit("\\e"), F.lit(""))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def prefix_target_examples(turns: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """conv_id, talk (null but for conversations without id), example_no (from 1), target_turn (position from 1), n_turns, text, loss_start and
    loss_chars (code points in ``text``; loss_start is null in a closing example)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit(SEPARATOR))
    body = escape(text)
    rendered = turns.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("talk"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), F.concat(head, body, F.lit(CLOSE + "\n")).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"), (role == trainable_role).alias("train")).alias("t"),
    )
    talks = rendered.groupBy("conv_id", "talk").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("ts", i)["train"])
    targets = F.when(F.element_at("ts", -1)["train"], replies).otherwise(F.array_append(replies, n))
    one = talks.withColumn("targets", targets).select("conv_id", "talk", F.transform("ts", lambda t: t["piece"]).alias("pieces"), F.transform("ts", lambda t: F.struct(t["train"].alias("train"), t["head"].alias("head"), t["body"].alias("body"))).alias("marks"), F.posexplode("targets").alias("k", "target"))
    mark = F.element_at("marks", F.col("target"))
    context = F.array_join(F.slice("pieces", 1, F.col("target") - 1), "")
    return one.select("conv_id", "talk", (F.col("k") + 1).alias("example_no"), F.col("target").alias("target_turn"), F.size("pieces").alias("n_turns"), context.alias("context"), F.element_at("pieces", F.col("target")).alias("piece"), mark.alias("mark")).select(
        "conv_id",
        "talk",
        "example_no",
        "target_turn",
        "n_turns",
        F.concat("context", "piece").alias("text"),
        F.when(F.col("mark.train"), F.length("context") + F.col("mark.head")).alias("loss_start"),
        F.when(F.col("mark.train"), F.col("mark.body")).otherwise(0).alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as array<struct<role, text>>."""
    pieces = F.split(text, CLOSE + "\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        head = F.substring_index(piece, SEPARATOR, 1)
        role = F.substr(head, F.lit(len(OPEN) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, F.length(head) + 1 + len(SEPARATOR))).alias("text"))

    return F.transform(pieces, parse)


def loss_text(text: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped; empty where there is none."""
    return F.coalesce(unescape(F.substr(text, start + 1, chars)), F.lit(""))

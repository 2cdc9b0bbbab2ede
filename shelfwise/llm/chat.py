"""Training examples from conversations by prefix-target expansion, in SQL functions.

A turn is written as

    [INST] role [/INST] text </s>          (without the spaces)

In roles and texts a backslash follows every ``<``, ``[`` and backslash, so that no
control string can occur inside them; taking it out again gives the text back.

Every assistant turn becomes an example: all turns before it as context, then the turn
itself, whose text alone is trainable. A conversation that does not end with an
assistant turn has one more example with nothing trainable, so that no turn is lost.

Turns follow ``turn``; equal turn numbers follow role and text, nulls first. Null
roles and texts are empty. Nothing tells which rows without a conversation id belong
together: each is a conversation of one turn, and has a row of its own in the summary.
Repeated rows are turns of their own. An empty table gives no examples. A text may be
as long as a Spark string; the context of n turns costs n times their text, which is
what the method asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEADED, CLOSE = "[INST]", "[/INST]", "</s>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(HEADED), escape(text), F.lit(CLOSE))


def expand(conversations: DataFrame) -> DataFrame:
    """Examples ``(conv_id, example, complete, text, loss_start, loss_end)``.

    ``example`` is the number of turns, ``complete`` marks the one that holds the whole
    conversation. The trainable span counts code points from 0; it is empty where
    nothing is trained.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long"),
        F.struct(
            F.col("turn").cast("long"),
            role.alias("role"),
            text.alias("text"),
        ).alias("item"),
    )
    named = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    unnamed = turns.where("conv_id is null").select("conv_id", F.array("item").alias("items"))
    whole = named.union(unnamed)
    formatted = whole.select(
        "conv_id",
        F.size("items").alias("n"),
        "items.role",
        F.transform("items", lambda item: format_turn(item.role, item.text)).alias("written"),
    )
    places = F.filter(
        F.sequence(F.lit(1), F.col("n")), lambda i: (F.get("role", i - 1) == TRAINED_ROLE) | (i == F.col("n"))
    )
    examples = formatted.select("*", F.explode(places).alias("example"))
    trained = F.get("role", F.col("example") - 1) == TRAINED_ROLE
    end = F.length("text") - len(CLOSE)
    reply = F.length(F.get("written", F.col("example") - 1)) - len(OPEN + TRAINED_ROLE + HEADED + CLOSE)
    return (
        examples.withColumn("text", F.array_join(F.slice("written", F.lit(1), F.col("example")), ""))
        .withColumn("loss_start", F.when(trained, end - reply).otherwise(end))
        .withColumn("loss_end", end)
        .select("conv_id", "example", (F.col("example") == F.col("n")).alias("complete"), "text", "loss_start", "loss_end")
    )


def parse(text: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted text."""
    written = F.split(text, CLOSE, -1)
    turns = F.slice(written, F.lit(1), F.size(written) - 1)
    return F.transform(
        turns,
        lambda turn: F.struct(
            unescape(F.substring_index(F.substring(turn, F.lit(len(OPEN) + 1), F.length(turn)), HEADED, 1)).alias("role"),
            unescape(F.substring_index(turn, HEADED, -1)).alias("text"),
        ),
    )


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """What is trained, as it was before escaping."""
    return unescape(F.substring(text, start + 1, end - start))


def summarise(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, from its written examples alone."""
    turns = F.transform(parse(F.col("text")), lambda turn: F.concat(turn.role, F.lit("\n"), turn.text, F.lit("\n")))
    read = examples.select(
        "conv_id",
        F.length("text").alias("chars"),
        F.when(F.col("complete"), F.col("example")).alias("n_turns"),
        F.when(F.col("complete"), F.sha2(F.array_join(turns, "").cast("binary"), 256)).alias("turns_sha256"),
        F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss")).alias("reply"),
    )
    replies = F.array_join(F.array_sort(F.collect_list("reply")).getField("loss"), "")
    named = read.where("conv_id is not null").groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        replies.alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    unnamed = read.where("conv_id is null").select(
        "conv_id",
        F.col("n_turns").cast("long"),
        "turns_sha256",
        F.col("reply.loss").alias("loss"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )
    return named.union(unnamed).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

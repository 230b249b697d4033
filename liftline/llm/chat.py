"""Preference formatting of chosen and rejected conversations, on DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.operators.keyed import skew_safe_join

START, END = "<|im_start|>", "<|im_end|>"  # fixed values of the ChatML format
TRAINED_ROLE = "assistant"


def _render(turn: Column) -> Column:
    return F.concat(F.lit(START), turn.role, F.lit("\n"), turn.text, F.lit(END + "\n"))


def _mask(turn: Column) -> Column:
    """Runs of characters of a rendered turn: ``n-`` without and ``n+`` with loss."""
    head = F.length(turn.role) + len(START) + 1
    body = F.length(turn.text) + len(END)
    trained = F.concat(head.cast("string"), F.lit("-"), body.cast("string"), F.lit("+1-"))
    return F.when(turn.role == TRAINED_ROLE, trained).otherwise(
        F.concat((head + body + 1).cast("string"), F.lit("-"))
    )


def with_other_answers(conversations: DataFrame) -> DataFrame:
    """Pairs for :func:`preference_rows` from ``conv_id``, ``turn``, ``role``, ``text``.

    Each conversation is chosen as it is. Rejected are the same turns, with the last one of the
    assistant replaced by the last one that the assistant says in conversation conv_id + 1, or
    by an empty text if that has none. Without a turn of the assistant both are equal.
    Last is the largest number, then the largest text; rows that repeat that turn are
    replaced together. Rows without conv_id belong to none.
    """
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    said = turns.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("said"))
    other = said.select(F.try_subtract("conv_id", F.lit(1)).alias("conv_id"), F.col("said.text").alias("other"))
    known = said.join(other.where("conv_id is not null"), "conv_id", "left")
    joined = skew_safe_join(turns, known, ["conv_id"])
    last = (F.col("role") == TRAINED_ROLE) & F.col("turn").eqNullSafe(F.col("said.turn")) & (F.col("text") == F.col("said.text"))
    text = F.when(last, F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), text.alias("text")))
    return joined.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.inline(sides))


def preference_rows(turns: DataFrame) -> DataFrame:
    """One row per pair of conversations.

    ``turns`` has ``pair_id``, ``side`` (``chosen`` or ``rejected``), ``turn``, ``role``,
    ``text``. Returns ``pair_id``, ``common_turns`` (the longest common prefix of turns
    with the same role and text), ``prompt`` (that prefix, rendered once), ``chosen`` and
    ``rejected`` (the rest of either side) with ``chosen_mask`` and ``rejected_mask``:
    runs of characters, ``n-`` for those without loss and ``n+`` for the text and end
    mark of assistant turns.

    Turns are ordered by number, then role and text; a null number comes first, a null
    role or text counts as empty. Repeated rows are repeated turns. A side that is a
    prefix of the other, or equal to it, has an empty completion. A pair without one of
    its sides, other sides, and a null pair_id give no row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def side(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == name, turn)))

    pairs = (
        turns.where("pair_id is not null")
        .groupBy("pair_id")
        .agg(side("chosen").alias("c"), side("rejected").alias("r"))
        .where((F.size("c") > 0) & (F.size("r") > 0))
    )
    differs = F.array_position(
        F.zip_with("c", "r", lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False))),
        False,
    )
    common = F.when(differs > 0, differs - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int")
    cut = pairs.withColumn("common_turns", common)

    def rest(name: str) -> Column:
        return F.slice(name, F.col("common_turns") + 1, F.greatest(F.size(name), F.lit(1)))

    def text(part: Column) -> Column:
        return F.array_join(F.transform(part, _render), "")

    def mask(part: Column) -> Column:
        return F.array_join(F.transform(part, _mask), "")

    return cut.select(
        "pair_id",
        "common_turns",
        text(F.slice("c", F.lit(1), F.col("common_turns"))).alias("prompt"),
        text(rest("c")).alias("chosen"),
        mask(rest("c")).alias("chosen_mask"),
        text(rest("r")).alias("rejected"),
        mask(rest("r")).alias("rejected_mask"),
    )

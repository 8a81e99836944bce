"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users.  The mask gives the
spans of the rendered text a model is to learn: the assistant's words and end
marks.  Context speakers (``system``) are shown in every perspective but take
none.

A turn is rendered as

    <|assistant|>\\ntext<|end|>\\n            (the perspective's speaker)
    <|user:name|>\\ntext<|end|>\\n            (another participant)
    <|system|>\\ntext<|end|>\\n               (a context speaker)

Conversations are numbered by :func:`row_sequence`, which spreads one that is
too long for a task, and rendered in parts of at most ``part_turns`` turns; a
conversation of no more turns is one part.  So no task holds a long conversation
whole, and the parts of a perspective joined in order are the whole dialogue.

Edge cases: turns are ordered by turn (nulls first), then speaker, then text, so
ties and repeated rows have a fixed order and repeated rows stay.  A null text is
empty, a null or empty speaker is "unknown".  Marks inside a text are broken by a
space after "<", so that no text forges a turn; the mask counts the rendered text.  A
null conversation id is one conversation of its own.  A conversation of context
alone has no perspective and no row.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import row_sequence

PART_TURNS = 64
CONTEXT = ("system",)
END = "<|end|>\n"


def perspectives(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 speaker_col: str = "role", text_col: str = "text",
                 context: Sequence[str] = CONTEXT, part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv, speaker, part, n_turns, text, mask)``: one row for each part of
    each perspective.  ``mask`` holds ``(start, stop)`` in characters, the stop
    excluded, one pair for each turn of the speaker."""
    spoken = F.coalesce(F.nullif(F.col(speaker_col).cast("string"), F.lit("")), F.lit("unknown"))
    turns = chats.select(
        F.col(conv_col).alias("conv"), F.col(conv_col).isNull().alias("nameless"),
        F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("key"),
        F.col(turn_col).alias("turn"), spoken.alias("speaker"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    numbered = row_sequence(turns, ["nameless", "key"], ["turn", "speaker", "text"], name="seq")
    part = F.floor((F.col("seq") - 1) / part_turns).alias("part")
    parts = (numbered.groupBy("nameless", "key", part)
             .agg(F.array_sort(F.collect_list(F.struct("seq", "speaker", "text"))).alias("turns"),
                  F.first("conv").alias("conv")))
    seats = (turns.where(~F.col("speaker").isin(list(context)))
             .select("nameless", "key", F.col("speaker").alias("seat")).distinct())
    seen = parts.join(seats, ["nameless", "key"])

    def head(t):
        return (F.when(t["speaker"] == F.col("seat"), F.lit("<|assistant|>\n"))
                .when(t["speaker"].isin(list(context)), F.concat(F.lit("<|"), t["speaker"], F.lit("|>\n")))
                .otherwise(F.concat(F.lit("<|user:"), t["speaker"], F.lit("|>\n"))))

    drawn = seen.withColumn("drawn", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"),
        (t["speaker"] == F.col("seat")).alias("own"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.expr("cast(array() AS array<struct<start:bigint, stop:bigint>>)").alias("mask"))

    def step(done, t):
        begin = done["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        # The newline after the end mark is layout, not learnt.
        own = F.array(F.struct(begin.alias("start"), (end - 1).alias("stop")))
        return F.struct(end.alias("at"),
                        F.when(t["own"], F.concat(done["mask"], own)).otherwise(done["mask"]).alias("mask"))

    return drawn.select(
        "conv", F.col("seat").alias("speaker"), F.col("part").cast("bigint").alias("part"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("drawn", lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        F.aggregate("drawn", start, step, lambda done: done["mask"]).alias("mask"))

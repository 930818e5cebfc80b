"""The memory block of a turn: which text asks, whether it is asked at all, and where the
block enters the turn's messages.

Messages: session_id, turn, step, pos, kind, plugin, claimed (part of what the step
took up) and text, one row each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distill

PLUGIN, MAX_QUERY = "tessera", 4000
TURN = ["session_id", "turn"]


def is_own() -> Column:
    """Messages that this engine put there: never a question."""
    return (F.col("kind") == "plugin") & F.coalesce(F.col("plugin") == PLUGIN, F.lit(False))


def asked(messages: DataFrame, max_chars: int = MAX_QUERY) -> DataFrame:
    """(session_id, turn, query) of the turns to be answered: at their first step, the last
    message claimed there that a user wrote, unless it is longer than max_chars; of a
    long one what its heuristic distillation keeps."""
    said = F.trim("text")
    mine = messages.where((F.col("step") == 1) & F.col("claimed") & (F.col("kind") == "user") & (said != ""))
    last = mine.groupBy(*TURN).agg(F.max_by(said, "pos").alias("raw"))
    return last.where(F.length("raw") <= max_chars).select(*TURN, distill(F.col("raw")).alias("query"))


def spliced(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """messages with each turn's block (session_id, turn, block) after the last claimed
    message of its first step, or before all if none is; a turn that holds a block of
    this engine already gets no other.  pos is numbered anew, from 0."""
    first = messages.where("step = 1")
    at = first.groupBy(*TURN).agg(F.max(F.when(F.col("claimed"), F.col("pos"))).alias("_last"), F.bool_or(is_own()).alias("_has"))
    fresh = blocks.join(at.where("NOT _has"), TURN).where("block IS NOT NULL AND block <> ''")
    fresh = fresh.select(*TURN, F.lit(1).alias("step"), F.coalesce(F.col("_last") + 0.5, F.lit(-0.5)).alias("pos"), F.lit("plugin").alias("kind"), F.lit(PLUGIN).alias("plugin"), F.lit(False).alias("claimed"), F.col("block").alias("text"))
    both = messages.withColumn("pos", F.col("pos").cast("double")).unionByName(fresh)
    nth = F.row_number().over(Window.partitionBy(*TURN).orderBy("step", "pos")) - 1
    return both.withColumn("pos", nth)


def inject(messages: DataFrame, block: Callable[[str], str]) -> DataFrame:
    """messages with the block that `block` makes of each turn's question, in a batch of
    turns (foreachBatch): their questions, one a turn, are put to it on the driver, as
    each is a retrieval of its own.  A retrieval that fails breaks no turn."""
    rows = []
    for r in asked(messages).toLocalIterator():
        try:
            made = block(r["query"])
        except Exception:  # the turn goes on without memory
            made = ""
        rows.append((r["session_id"], r["turn"], made))
    kinds = dict(messages.dtypes)
    return spliced(messages, messages.sparkSession.createDataFrame(rows, f"session_id {kinds['session_id']}, turn {kinds['turn']}, block string"))

"""Turn ends as a stream of extraction jobs, written once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sessions import SESSION_EVENT


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(f"session_id STRING, {SESSION_EVENT}").option("maxFilesPerTrigger", files_per_trigger).json(path)


def completed_turns(events: DataFrame) -> DataFrame:
    """Turns that ended by completing."""
    return events.where((F.col("type") == "turn/end") & (F.col("data.reason.kind") == "completed")).select("session_id", F.col("data.turn").alias("turn"), F.col("time").alias("mention_time"), "seq")


def run_jobs(turns: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Hand each micro-batch of jobs, one a (session, turn), to handle(batch, id).
    A batch may be handed again after a crash, so handle must be idempotent, as
    graph.new_only makes it.  With once, the query ends when the input is drained."""

    def each(batch: DataFrame, number: int) -> None:
        handle(batch.dropDuplicates(["session_id", "turn"]), number)

    writer = turns.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()

"""The job log: pending, failed, settled and abandoned records, folded per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import JOB_LOG
from ..sources.journal import numbered_lines, write_lines
from .models import retry_delay

KEEP_ABANDONED, MAX_ROUNDS = 100, 10
#: Seconds before the attempts after the first, the last repeating; between job starts.
BACKOFF, START_GAP = (15, 60, 180, 600), 3.0
KINDS = ("pending", "failed", "settled", "abandoned")
RECORD = [x.split()[0] for x in JOB_LOG.split(", ")][1:]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's records in order; lines that are no record, such as a torn last one, are skipped."""
    lines = numbered_lines(spark, path)
    parsed = F.from_json("value", ", ".join(x for x in JOB_LOG.split(", ") if not x.startswith("seq ")))
    return lines.select("seq", parsed.alias("r")).select("seq", "r.*").where(F.col("kind").isin(*KINDS) & F.col("session_id").isNotNull())


def append_log(records: DataFrame, path: str) -> None:
    """Add records of any of the four kinds; columns that a kind has no use for are null."""
    types = dict(x.split(" ", 1) for x in JOB_LOG.split(", "))
    whole = records.withColumns({c: F.lit(None).cast(types[c].lower()) for c in RECORD if c not in records.columns})
    write_lines(whole, RECORD, path)


def enqueued(turns: DataFrame, log: DataFrame) -> DataFrame:
    """Pending records of turns (session_id, turn, job) that aren't outstanding already;
    a turn is free again once it is settled or abandoned."""
    open_ = fold(log).select("session_id", "turn")
    return turns.dropDuplicates(["session_id", "turn"]).join(open_, ["session_id", "turn"], "left_anti").select(F.lit("pending").alias("kind"), "session_id", "turn", "job", F.lit(0).alias("failures"))


def booked(log: DataFrame, results: DataFrame, at: str, cap: int = MAX_ROUNDS) -> DataFrame:
    """Records of a round's results (session_id, turn, ok, error): settled, or failed with
    the round counted, or abandoned where that reaches the cap."""
    state = results.join(fold(log).select("session_id", "turn", F.col("failures").alias("_f")), ["session_id", "turn"])
    rounds = F.col("_f") + 1
    kind = F.when(F.col("ok"), "settled").when(rounds >= cap, "abandoned").otherwise("failed")
    told = lambda c: F.when(~F.col("ok"), c)
    return state.select(kind.alias("kind"), "session_id", "turn", told(rounds).cast("int").alias("failures"), told(F.col("error")).alias("error"), told(F.lit(at).cast("timestamp")).alias("at"))


def requeued(log: DataFrame, at: str, cap: int = MAX_ROUNDS, failed_only: bool = False) -> DataFrame:
    """Records that a retry pass writes for outstanding jobs: pending again, with the
    failures and the last error carried, or abandoned where the rounds are used up."""
    state = fold(log).where("job IS NOT NULL")
    state = state.where("last_at IS NOT NULL") if failed_only else state
    over = F.col("failures") >= cap
    kind = F.when(over, "abandoned").otherwise("pending")
    error = F.when(over, F.coalesce("last_error", F.lit("retries exhausted"))).otherwise(F.col("last_error"))
    return state.select(kind.alias("kind"), "session_id", "turn", F.when(~over, F.col("job")).alias("job"), "failures", error.alias("error"), F.when(over, F.lit(at).cast("timestamp")).otherwise(F.col("last_at")).alias("at"), "first_seq").orderBy("first_seq").drop("first_seq")


def next_attempt(attempt: Column, r: Column) -> Column:
    """Seconds to wait after the given attempt (from 1) failed; r in [0, 1) is given."""
    base = F.element_at(F.array(*map(F.lit, BACKOFF)), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(BACKOFF))).cast("int"))
    return retry_delay(base * 1000, r) / 1000


def paced(jobs: DataFrame, order: str = "first_seq", gap: float = START_GAP) -> DataFrame:
    """jobs with start_after, seconds from now: fresh starts are `gap` apart, in order.  The
    jobs are one batch's, which the stream's trigger bounds, so one window numbers them."""
    return jobs.withColumn("start_after", (F.row_number().over(Window.orderBy(order)) - 1) * F.lit(gap))


def fold(log: DataFrame, keys: tuple[str, ...] = ("session_id", "turn")) -> DataFrame:
    """State of each job after its last terminal record: the last pending record's
    job, failures carried by it plus one a failed record (or the count that one
    gives), the last error, and the place of its first enqueue.  One window a key."""
    whole = Window.partitionBy(*keys)
    end = F.max(F.when(F.col("kind").isin("settled", "abandoned"), F.col("seq"))).over(whole)
    live = log.withColumn("_end", end).where("_end IS NULL OR seq > _end")
    # a count that a record gives restarts the counting from there
    given = F.max(F.when(F.col("failures").isNotNull(), F.col("seq"))).over(whole)
    live = live.withColumn("_given", given)
    count = F.coalesce(F.max(F.when(F.col("seq") == F.col("_given"), F.col("failures"))), F.lit(0)) + F.count_if((F.col("kind") == "failed") & (F.col("_given").isNull() | (F.col("seq") > F.col("_given"))))
    out = live.groupBy(*keys).agg(
        F.min(F.when(F.col("kind") == "pending", F.col("seq"))).alias("first_seq"),
        F.max_by("job", F.when(F.col("kind") == "pending", F.col("seq"))).alias("job"),
        count.cast("int").alias("failures"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("last_error"),
        F.max(F.when(F.col("kind") == "failed", F.col("at"))).alias("last_at"),
    )
    return out.where("first_seq IS NOT NULL")


def outstanding(log: DataFrame) -> DataFrame:
    return fold(log).orderBy("first_seq")


def counts(log: DataFrame) -> DataFrame:
    """backlog, failing (outstanding with failures) and abandoned."""
    now = fold(log).agg(F.count("*").alias("backlog"), F.expr("count_if(failures > 0)").alias("failing"))
    return now.crossJoin(F.broadcast(log.agg(F.count_if(F.col("kind") == "abandoned").alias("abandoned"))))


def latest_failure(log: DataFrame) -> DataFrame:
    return fold(log).where("last_at IS NOT NULL").orderBy(F.desc("last_at"), "first_seq").limit(1)


def compacted(log: DataFrame) -> DataFrame:
    """The newest abandoned records, which are all that is rewritten."""
    return log.where("kind = 'abandoned'").orderBy(F.desc("seq")).limit(KEEP_ABANDONED)


def drained(log: DataFrame, keys: tuple[str, ...] = ("session_id", "turn")) -> DataFrame:
    """One row, drained: every pending job has a settled record."""
    open_ = log.where("kind = 'pending'").select(*keys).distinct().join(log.where("kind = 'settled'").select(*keys).distinct(), list(keys), "left_anti")
    return open_.agg((F.count("*") == 0).alias("drained"))


def retryable(log: DataFrame, now: str, cool_down: str = "INTERVAL 10 MINUTES") -> DataFrame:
    """Outstanding jobs whose last failure is cool and whose rounds aren't used up."""
    state = fold(log)
    return state.where((F.col("failures") < MAX_ROUNDS) & (F.col("last_at").isNull() | (F.col("last_at") <= F.lit(now).cast("timestamp") - F.expr(cool_down))))

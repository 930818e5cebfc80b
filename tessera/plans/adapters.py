"""The driver's tables as a memory graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that executors share, for queries that write files before they read
    them; a temporary one where driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:" + tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as facts: subject = user, predicate = type, mention = ts; the event
    time lies up to ten days before it, and is missing for every third."""
    e = table(spark, sf_dir, "events")
    happened = F.col("ts") - F.make_dt_interval(F.pmod("event_id", F.lit(11)).cast("int"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("subject"),
        F.col("event_type").alias("predicate"),
        F.floor(F.col("value") / 10).cast("long").alias("object_value"),
        F.when(F.col("event_id") % 3 != 0, happened).alias("event_time"),
        F.col("ts").alias("mention_time"),
        (F.col("event_id") % 17 == 0).alias("speech_act"),
        F.col("event_id").alias("ins_seq"),
        "value",
    )


#: The same rows for the oracle.
EVENTS_SQL = """ev AS (SELECT event_id AS id, user_id AS subject, event_type AS predicate, CAST(floor(value / 10) AS BIGINT) AS object_value,
 CASE WHEN event_id % 3 <> 0 THEN ts - to_days(CAST(event_id % 11 AS INTEGER)) END AS event_time, ts AS mention_time, event_id % 17 = 0 AS speech_act, event_id AS ins_seq, value FROM events)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal over events: each added at 2*id, every fifth again at 2n+id, every
    seventh deleted at 4n+id, every 35th added once more at 6n+id; n = 10^9."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")

    def part(divisor: int, op: str, at: int) -> DataFrame:
        return e.where(F.col("event_id") % divisor == 0).select((F.col("event_id") * (2 if at == 0 else 1) + F.lit(at * 1_000_000_000).cast("long")).alias("seq"), F.lit(op).alias("op"), F.col("event_id").alias("rid"), F.concat_ws(":", "event_type", F.lit(at)).alias("payload"))

    parts = [part(1, "event.add", 0), part(5, "event.add", 2), part(7, "event.delete", 4), part(35, "event.add", 6)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


JOURNAL_SQL = """j AS (SELECT event_id * 2 AS seq, 'event.add' AS op, event_id AS rid, event_type || ':0' AS payload FROM events
 UNION ALL SELECT 2000000000 + event_id, 'event.add', event_id, event_type || ':2' FROM events WHERE event_id % 5 = 0
 UNION ALL SELECT 4000000000 + event_id, 'event.delete', event_id, event_type || ':4' FROM events WHERE event_id % 7 = 0
 UNION ALL SELECT 6000000000 + event_id, 'event.add', event_id, event_type || ':6' FROM events WHERE event_id % 35 = 0)"""


def orders_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as hyper-edges: (event_id, entity_id) of part and supplier, ins_seq."""
    l = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return l.select(key.alias("event_id"), F.explode(F.array(F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey")))).alias("entity_id"), key.alias("ins_seq"))


BRIDGE_SQL = """br AS (SELECT l_orderkey * 8 + l_linenumber AS event_id, 'p' || l_partkey AS entity_id, l_orderkey * 8 + l_linenumber AS ins_seq FROM lineitem
 UNION ALL SELECT l_orderkey * 8 + l_linenumber, 's' || l_suppkey, l_orderkey * 8 + l_linenumber FROM lineitem)"""


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    share_package(spark)
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], names: str) -> str:
    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, int | float):
            return str(x)
        return "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"

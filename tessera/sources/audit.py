"""The audit log: one row for everything a pipeline wants to tell, kept beside its data."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUDIT = "at TIMESTAMP, kind STRING, detail STRING"


def audit_rows(rows: DataFrame, kind: str, at: str | None = None) -> DataFrame:
    """rows as rows of the log: all their columns as JSON in detail."""
    when = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    return rows.select(when.alias("at"), F.lit(kind).alias("kind"), F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("detail"))


def append_audit(rows: DataFrame, path: str) -> bool:
    """Add rows to the log.  A log that can't be written never breaks the work it tells
    of: the failure goes to the driver's own log, and False is returned."""
    try:
        rows.write.mode("append").json(path)
    except Exception:  # whatever the store says
        logging.getLogger(__name__).warning("audit log %s can't be written", path, exc_info=True)
        return False
    return True


def read_audit(spark, path: str, kind: str | None = None) -> DataFrame:
    rows = spark.read.schema(AUDIT).json(path)
    return rows.where(F.col("kind") == kind) if kind else rows

"""Journal lines: append, read in order, bulk scopes, compaction by an atomic swap.

A journal is a folder; every append writes one numbered folder of text files in
it, so the order of paths is the order of writing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import replay, valid_records
from ..schema import JOURNAL

#: Mutations after which a journal is compacted.
COMPACT_AT = 1000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) of the lines of all text files under path, by path and place in the
    file.  Each split of a file is numbered by itself; only the splits' counts meet in
    one place, a row for each split."""
    found = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    splits = found.groupBy("file", "split").agg(F.min("line").alias("low"), (F.max("line") - F.min("line") + 1).alias("n"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    based = splits.select("file", "split", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = found.join(based, ["file", "split"])
    return numbered.select((F.col("base") + F.col("line") - F.col("low")).alias("seq"), "value")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """seq and the record's columns; lines that don't parse are in _corrupt, blank ones
    are skipped."""
    return parse_lines(numbered_lines(spark, path))


def scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every event and entity record ever written, the last of each id, as the ad-hoc
    readers of audits see a journal: deletes are not looked at, unlike live()."""
    records = valid_records(read_journal(spark, path)).where(F.col("op").isin("event.add", "entity.upsert"))
    last = records.groupBy("op", F.col("data.id").alias("id")).agg(F.max_by("data", "seq").alias("data"))
    return last.select("op", "data.*")


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (seq, value) -> seq and the record's columns."""
    parsed = F.from_json("value", JOURNAL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.where(F.trim("value") != "").select("seq", parsed.alias("r")).select("seq", "r.*")


def live(records: DataFrame, kind: str) -> DataFrame:
    return replay(valid_records(records), kind, F.col("data.id")).select("data.*", "ins_seq")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_lines(rows: DataFrame, columns: list[str], path: str) -> None:
    """Add the columns as JSON lines after all there are, in the order of seq if there is one."""
    fs, where = _folder(rows.sparkSession, path)
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()] if fs.exists(where) else []
    ordered = rows.orderBy("seq") if "seq" in rows.columns else rows
    ordered.select(F.to_json(F.struct(*columns)).alias("value")).write.text(f"{path}/{max(numbers, default=0) + 1:012d}")


def append(records: DataFrame, path: str) -> None:
    """Add records (v, op, data, and seq if their order matters) after all there are."""
    write_lines(records, ["v", "op", "data"], path)


def compact(records: DataFrame, root: str) -> str:
    """Write live entities and events as a new version, then point `current` to it in
    one rename; readers see the old version or the new one, never a mixture or none."""
    spark, version = records.sparkSession, uuid.uuid4().hex
    for kind, name in (("entity", "entities"), ("event", "events")):
        live(records, kind).write.parquet(f"{root}/versions/{version}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, now = (jvm.org.apache.hadoop.fs.Path(f"{root}/{p}") for p in (f"current.{version}", "current"))
    out = now.getFileSystem(conf).create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(now.getFileSystem(conf).getUri(), conf)
    files.rename(files.makeQualified(new), files.makeQualified(now), how)
    return version


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = spark.read.text(f"{root}/current").head()[0]
    return spark.read.parquet(f"{root}/versions/{version}/{name}")


class Journal:
    """A journal under root/log that compacts itself every `compact_at` mutations; within
    bulk(), which may be nested, once at the outermost end."""

    def __init__(self, spark: SparkSession, root: str, compact_at: int = COMPACT_AT):
        self.spark, self.root, self.compact_at = spark, root, compact_at
        self.ops = self.depth = self.snapshots = 0

    def append(self, records: DataFrame) -> None:
        append(records, f"{self.root}/log")
        self.ops += records.count()
        self._settle()

    def records(self) -> DataFrame:
        return read_journal(self.spark, f"{self.root}/log")

    @contextmanager
    def bulk(self) -> Iterator["Journal"]:
        self.depth += 1
        try:
            yield self
        finally:
            self.depth -= 1
            self._settle()

    def _settle(self) -> None:
        if not self.depth and self.ops >= self.compact_at:
            compact(self.records(), self.root)
            self.ops, self.snapshots = 0, self.snapshots + 1

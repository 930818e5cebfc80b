"""Shared helpers of the training-data operators.

Null rule used everywhere unless an operator says otherwise: a null text is an
empty text, a null doc_id stays null and its row is still returned.  Operators
only look at the columns they name, so extra columns never clash.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import hashlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, list[str]] = {}


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies on a shared path."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only what the per-document operators need."""
    importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster.  Where none is set, a temporary one, but only
    if driver and executors are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that this package wrote."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, True)


def _remove_at_exit(spark: SparkSession, paths: list[str]) -> None:
    with contextlib.suppress(Py4JError, OSError, AttributeError):  # the session may be gone; the folder belongs to the cluster then
        remove(spark, paths)


def keep_scratch(spark: SparkSession, path: str) -> None:
    """Delete path when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = []
        atexit.register(_remove_at_exit, spark, _SCRATCH[app])
    _SCRATCH[app].append(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage,
    survives the loss of executors and is computed once for several readers."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_scratch(spark, path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more;
    it does so when the driver collects garbage, which small drivers seldom do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, df: DataFrame) -> None:
    """Drop a materialized table that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        if "/tessera-" in folder:
            remove(spark, [folder])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into the session's number of shuffle partitions,
    which the deployment scales with the input."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def rows(batches: Iterator[pa.RecordBatch], cap: int = 8 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(doc ids, UTF-8 texts) in pieces of whole rows, about cap bytes each."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            if t is None:
                texts[i] = t = b""
            size += len(t)
            if size >= cap:
                yield ids[start : i + 1], texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(ids):
            yield ids[start:], texts[start:]


_MEMOS: list[weakref.ref] = []


class Memo(dict):
    """dict that computes a missing value; emptied when it has `most` entries, and
    without those of keys over `longest`, so a worker's memory stays bounded whatever
    the vocabulary."""

    def __init__(self, compute, most: int = 400_000, owner: str = "", longest: int = 64):
        super().__init__()
        self.compute, self.most, self.owner, self.longest = compute, most, owner, longest
        _MEMOS.append(weakref.ref(self, _MEMOS.remove))

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def trimmed(made):
    """made (a function of batches) that gives memory it no longer uses back to the
    system when a task ends, as workers stay and other stages need it."""

    @functools.wraps(made)
    def run(batches):
        try:
            yield from made(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)

    return run


def claim(owner: str) -> None:
    """A worker serves one operator after another: empty what the others remember."""
    for ref in list(_MEMOS):
        memo = ref()
        if memo is not None and memo.owner != owner:
            memo.clear()

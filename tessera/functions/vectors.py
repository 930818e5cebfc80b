"""Vector functions over ARRAY<FLOAT>, accumulated in double."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors to find neighbours for that are sent to the workers at a time.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for missing, empty, unequal or zero vectors."""
    size = norm(a) * norm(b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (size > 0), dot(a, b) / size).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def rounded(a: Column, digits: int = 4) -> Column:
    return F.transform(a, lambda x: F.round(x.cast("double"), digits))


def hash_embedding(text: Column, dim: int = 32) -> Column:
    """The offline embedder: words hashed to buckets, counted, normalized."""
    from .text import words_of

    bucket = F.transform(words_of(text), lambda w: F.pmod(F.aggregate(F.split(w, ""), F.lit(0), lambda h, ch: F.when(ch == "", h).otherwise((h * 31 + F.ascii(ch)) % 997)), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(bucket, lambda b: b == i)).cast("double"))
    return l2_normalize(counts)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of equal length; unusable ones (null, of another length, zero) are zero."""
    values = column.to_pylist()
    size = max((len(v) for v in values if v), default=0)
    out = np.zeros((len(values), size))
    for i, v in enumerate(values):
        if v and len(v) == size and None not in v:
            out[i] = v
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1.0)[:, None]


def _in_blocks(queries: DataFrame, base: DataFrame, pick, block: int) -> DataFrame:
    """(query_id, near_id, score) that `pick` takes of the score matrix of a block of
    queries and a batch of base, both (id, v).  Queries go to the workers in blocks of
    `block` vectors, whatever their number, and meet a batch as one matrix product."""
    ids, names = dict(base.dtypes)["id"], dict(queries.dtypes)["id"]
    out, held = None, []

    def met(part: list) -> DataFrame:
        asked, units = [r["id"] for r in part], _matrix(pa.array([r["v"] for r in part], pa.list_(pa.float64())))
        sent = base.sparkSession.sparkContext.broadcast((asked, units))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, q = sent.value
            for batch in batches:
                near, v = batch.column(0).to_pylist(), _matrix(batch.column(1))
                if not near or v.shape[1] != q.shape[1]:
                    continue
                order = sorted(range(len(near)), key=near.__getitem__)
                near, score = [near[i] for i in order], np.round(q @ v[order].T, 6)
                i, j = pick(asked, near, score)
                yield pa.RecordBatch.from_arrays([pa.array([asked[k] for k in i]), pa.array([near[k] for k in j], batch.schema.field(0).type), pa.array(score[i, j])], names=["query_id", "near_id", "score"])

        return base.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(scored, f"query_id {names}, near_id {ids}, score double")

    for r in queries.select("id", F.col("v").cast("array<double>").alias("v")).toLocalIterator():
        held.append(r)
        if len(held) == block:
            out = met(held) if out is None else out.union(met(held))
            held = []
    if held or out is None:
        out = met(held) if out is None else out.union(met(held))
    return out


def nearest(queries: DataFrame, base: DataFrame, least: float = -1.0, block: int = BLOCK) -> DataFrame:
    """(query_id, near_id, score): of the queries (id, v), the row of base (id, v) with
    the largest cosine, rounded to six digits, of at least `least`; the smaller id of
    equals, never itself."""

    def best(asked: list, near: list, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = {x: j for j, x in enumerate(near)}
        for i, x in enumerate(asked):
            if x in place:
                score[i, place[x]] = -2.0
        top = score.argmax(axis=1)
        ok = np.flatnonzero(score[np.arange(len(asked)), top] >= least)
        return ok, top[ok]

    found = _in_blocks(queries, base, best, block)
    top = found.groupBy("query_id").agg(F.max("score").alias("score"), F.min_by("near_id", F.struct((-F.col("score")).alias("s"), "near_id")).alias("near_id"))
    return top.select("query_id", "near_id", "score")


def alike(queries: DataFrame, base: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(query_id, near_id, score) of all pairs with a cosine of at least `least`."""
    return _in_blocks(queries, base, lambda asked, near, score: np.nonzero(score >= least), block)

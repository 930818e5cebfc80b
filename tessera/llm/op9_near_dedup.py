"""MinHash near-duplicates: signatures, banding, verification, components.

1. Every document's shingle set is reduced to a fingerprint and BANDS band keys
   of ROWS minima each, of universal hash functions.  Documents with equal sets
   form a class, represented by its smallest doc_id.
2. Representatives that share a band key are candidates.  A pair at the
   threshold is missed by all bands with probability (1 - 0.8^5)^36 < 1e-6.
3. A bucket's members are not all paired: each meets the head of its group, and
   heads meet those of larger groups (candidates).  Pairs are verified on full sets.
4. Linked pairs give components (large-star / small-star).  The members of buckets
   that still lie in several components are taken up again by an exact prefix join
   over their whole sets, which finds every link between two components; inside a
   component nothing need be compared.

Verification moves compressed texts of candidates only.  Null and empty texts and those without words have an
empty set and are linked with nothing; they, and rows without doc_id, are kept.
Rows that repeat a doc_id are classed by their own texts and share their links: the
id is linked if one of its texts is.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import candidates, common
from .components import components

SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 36, 5
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M2
    return x ^ (x >> np.uint64(29))


@functools.cache
def _word_hash() -> common.Memo:
    return common.Memo(xxhash.xxh64_intdigest, 300_000, "op9")


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = data.lower().split()  # of bytes: A-Z only; splits at exactly space and 0x09-0x0D
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_word_hash().__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(size, len(w))
    x = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        x = mix(x * M1 + w[j : len(w) - k + 1 + j])
    return np.unique(x)


@functools.cache
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, of the minima of its hash functions."""
    a, b = _functions(bands * rows)
    low = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * a + b).min(axis=0), out=low)
    sig = low.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * M1 + sig[:, j])
    return key


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, fp1, fp2 (the set's fingerprint) and bands of every row."""

    def made(batches):
        common.claim("op9")
        for ids, texts in common.rows(batches):
            n, fp1, fp2, keys, seen = [], [], [], [], {}
            for t in texts:
                s = shingle_set(t, size)
                a, b = int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ M3).sum(dtype=np.uint64))
                if (a, b) not in seen:
                    seen[a, b] = band_keys(s, bands, rows).view(np.int64).tolist() if len(s) else []
                n.append(len(s))
                fp1.append(a)
                fp2.append(b)
                keys.append(seen[a, b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *[pa.array(np.array(f, dtype=np.uint64).view(np.int64)) for f in (fp1, fp2)], pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "fp1", "fp2", "bands"],
            )

    return common.doc_texts(docs).mapInArrow(common.trimmed(made), "doc_id long, n long, fp1 long, fp2 long, bands array<long>")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text."""

    def packed(batches):
        z = zstandard.ZstdCompressor(level=1)
        for ids, texts in common.rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([z.compress(t) for t in texts], pa.binary())], names=["doc_id", "z"])

    return common.doc_texts(docs).where("doc_id IS NOT NULL").mapInArrow(common.trimmed(packed), "doc_id long, z binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""

    def checked(batches):
        common.claim("op9")
        z = zstandard.ZstdDecompressor()
        sets = common.Memo(lambda packed: shingle_set(z.decompress(packed), size), 256, "op9", 1 << 16)
        for batch in batches:
            good = [similar(sets[a], sets[b], percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    right = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("z").alias("zv")), "v")
    both = right.join(texts.select(F.col("doc_id").alias("u"), F.col("z").alias("zu")), "u")
    return both.select("u", "v", "zu", "zv").mapInArrow(common.trimmed(checked), "u long, v long")


def opened_sets(opened: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(id, component, s): the shingles of the opened (id, component)."""

    def made(batches):
        common.claim("op9")
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            sets = [shingle_set(z.decompress(t), size).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["id", "component", "s"])

    held = opened.join(texts.withColumnRenamed("doc_id", "id"), "id").select("id", "component", "z")
    return held.mapInArrow(common.trimmed(made), "id long, component long, s array<long>")


def near_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    sig = common.materialize(signatures(docs, size, bands, rows), "signatures")
    usable = sig.where("n > 0 AND doc_id IS NOT NULL")
    classes = common.materialize(usable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = usable.join(classes.select(F.col("rep").alias("doc_id"), "fp1", "fp2"), ["doc_id", "fp1", "fp2"], "left_semi")
    banded = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    held = common.materialize(candidates.members(banded), "held")
    pairs = common.materialize(candidates.pairs(held), "pairs")
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    # ids grow with the input, so they are never broadcast
    texts = common.materialize(packed_texts(docs).join(ids.hint("merge"), "doc_id", "left_semi").distinct(), "texts")
    links = common.materialize(verify(pairs, texts, size, percent), "links")
    comps = components(links, "near")
    opened = common.materialize(candidates.opened(held, comps).select("id", "component").distinct(), "opened")
    if not opened.isEmpty():
        sets = common.materialize(opened_sets(opened, texts, size), "sets")
        fresh = common.materialize(candidates.prefix_pairs(sets, percent).join(pairs, ["u", "v"], "left_anti"), "fresh")
        found = common.materialize(verify(fresh, texts, size, percent), "found")
        if not found.isEmpty():  # components only grow, so nothing that lies across them is untried now
            comps = components(links.union(found), "near")
    named = classes.select("fp1", "fp2", F.col("rep").alias("node")).join(comps, "node", "left")
    named = named.select("fp1", "fp2", F.coalesce("component", "node").alias("component"))
    rows_ = sig.select("doc_id", "n", "fp1", "fp2")
    placed = rows_.join(named, ["fp1", "fp2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = placed.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without those that are not their component's least doc_id; same
    columns.  Rows that repeat a doc_id stay or go together."""
    gone = near_components(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(common.table(spark, sf_dir, "documents"), size=2)


def oracle_sql() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM k UNION ALL SELECT v, u FROM k),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

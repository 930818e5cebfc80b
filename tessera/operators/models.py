"""Pluggable models: embedders, detectors and their fallback chains, caches and budgets.

A model is a Python callable over a list of texts; it is loaded once a worker and
called a batch at a time.  What fails gives null, never an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cache_key

Embedder = Callable[[list[str]], list[list[float] | None] | None]
Detector = Callable[[str], list[tuple[str, str, float]] | None]
MIN_SCORE, MAX_MENTIONS, HEADROOM = 0.5, 40, 3.0


def embed(texts: DataFrame, column: str, chain: list[Embedder], batch: int = 256) -> DataFrame:
    """texts with embedding, and backend: the place in the chain of the one that
    answered (null: none did, so keyword matching applies)."""
    kinds = dict(texts.dtypes)
    names = texts.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, batch):
                part = b.slice(start, batch)
                asked = [t or "" for t in part.column(names.index(column)).to_pylist()]
                vectors: list = [None] * len(asked)
                backend: list = [None] * len(asked)
                for at, model in enumerate(chain):
                    open_ = [i for i, v in enumerate(vectors) if v is None]
                    if not open_:
                        break
                    try:
                        got = model([asked[i] for i in open_])
                    except Exception:  # the next of the chain answers
                        got = None
                    for i, v in zip(open_, got or [], strict=False):
                        if v is not None:
                            vectors[i], backend[i] = v, at
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(backend, pa.int32())], names=[*names, "embedding", "backend"])

    return texts.mapInArrow(made, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "embedding array<float>", "backend int"]))


def backfill(events: DataFrame, text: str, chain: list[Embedder], dim: int) -> DataFrame:
    """Vectors (id, embedding) of only those events whose vector is missing or of
    another size; append them to the side table of vectors."""
    return embed(events.where(stale_vector(F.col("embedding"), dim)).select("id", text), text, chain).where("embedding IS NOT NULL").select("id", "embedding")


def stale_vector(vector: Column, dim: int) -> Column:
    return vector.isNull() | (F.size(vector) != dim)


def detect(texts: DataFrame, column: str, chain: list[Detector]) -> DataFrame:
    """texts without the column's own, one row a mention: text, label, score and detector,
    the place in the chain of the one that answered.  A detector that fails or returns
    null leaves the text to the next; a text that none answers, or without a mention,
    has no rows."""
    kinds, names = dict(texts.dtypes), [c for c in texts.columns if c != column]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for place, model in enumerate(chain):
                    try:
                        got = model(t or "")
                    except Exception:  # the next of the chain answers
                        got = None
                    if got is not None:
                        at += [i] * len(got)
                        rows += [(*m, place) for m in got]
                        break
            kept = b.take(pa.array(at, pa.int64())).columns[:-1]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*(f"c{k}" for k in range(len(names))), "text", "label", "score", "detector"])

    picked = texts.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], F.col(column).alias("t"))
    schema = ", ".join([*(f"c{k} {kinds[c]}" for k, c in enumerate(names)), "text string, label string, score double, detector int"])
    return picked.mapInArrow(found, schema).withColumnsRenamed({f"c{k}": c for k, c in enumerate(names)})


def mentions(detected: DataFrame, key: str, labels: dict[str, str], order: str | None = None) -> DataFrame:
    """detected (key, text, label, score): the best score of each text, of MIN_SCORE
    or more, with a known label, the MAX_MENTIONS best of each key.  Of equal scores
    the first by order, a column of numbers, gives the label; without it, the last
    label in code-point order."""
    mapped = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    known = detected.withColumn("label", F.try_element_at(mapped, F.upper("label"))).where((F.col("score") >= MIN_SCORE) & F.col("label").isNotNull())
    best = known.groupBy(key, F.lower("text").alias("text")).agg(F.max_by("label", F.struct("score", -F.col(order) if order else F.col("label"))).alias("label"), F.max("score").alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "text")
    return best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MAX_MENTIONS).drop("_n")


def cached(queries: DataFrame, query: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with value, misses) by the normalized query; append answers of misses."""
    keyed = queries.withColumn("key", cache_key(F.col(query)))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")


def max_tokens(base: Column, headroom: Column, thinking: Column) -> Column:
    """The budget of a call that thinks: times headroom, whole; else the base."""
    widened = thinking & (headroom > 1) & ~F.isnan(headroom) & (headroom < float("inf"))
    return F.when(widened, F.floor(base * headroom)).otherwise(base)


def retry_delay(base: Column, r: Column) -> Column:
    """base jittered by a fifth either way; r in [0, 1) is given, so plans repeat."""
    return F.floor(base * (1 + 0.2 * (2 * r - 1)) + 0.5)


def word_pieces(text: str, vocabulary: dict[str, int], most: int = 128, unknown: str = "[UNK]", first: str = "[CLS]", last: str = "[SEP]") -> list[int]:
    """Ids of a text's pieces, longest match first within each basic token, between the
    two marks and padded with 0.  Basic tokens: lower case without combining marks,
    split at white space, every punctuation sign and CJK character by itself."""
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    spaced = "".join(f" {c} " if "一" <= c <= "鿿" or unicodedata.category(c)[0] == "P" or c in "$+<=>^`|~" else " " if c.isspace() or unicodedata.category(c) in ("Cc", "Cf") else c for c in bare)
    ids = [vocabulary[first]]
    for token in spaced.split():
        pieces, at = [], 0
        while at < len(token):
            end = next((e for e in range(len(token), at, -1) if ("##" if at else "") + token[at:e] in vocabulary), None)
            if end is None:
                pieces = [vocabulary[unknown]]
                break
            pieces.append(vocabulary[("##" if at else "") + token[at:end]])
            at = end
        ids += pieces
    ids = ids[: most - 1] + [vocabulary[last]]
    return ids + [0] * (most - len(ids))


def dense(vector: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """tanh(W x + b) of an array column; W has a row for each value of the result."""
    def row(w: list[float], b: float) -> Column:
        products = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x.cast("double") * y)
        return F.tanh(F.aggregate(products, F.lit(float(b)), lambda s, x: s + x))

    return F.array(*[row(w, b) for w, b in zip(weights, bias, strict=True)])


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The unit mean of those token vectors (an array of arrays) whose mask is 1."""
    from ..functions.vectors import l2_normalize

    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1)
    n = F.greatest(F.size(kept), F.lit(1))
    size = F.size(F.element_at(tokens, 1))
    mean = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.get(x["t"], i).cast("double")) / n)
    return l2_normalize(mean)

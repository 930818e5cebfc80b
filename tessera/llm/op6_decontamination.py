"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of about SHARD_WORDS words.  Its words are
mapped to the symbols of the benchmark's vocabulary (0: any other word, or a
document's end, so no match crosses documents), its suffixes are sorted, and the
Burrows-Wheeler transform is kept in a wavelet matrix of bit vectors, with a
count of ones before every 64 bits for ranks.  All benchmark windows are then
searched backwards at once; rows of the intervals are located by walking to
suffixes sampled every SAMPLE positions, which alone are kept, and the spans are
merged per document.

Documents are never shuffled.  The benchmark is sent to the workers in blocks
of whole items of at most BLOCK_BYTES of text (a larger item is a block of its
own, and in memory by itself); every document is searched for every block, and spans of several blocks
are merged in the row.

A window is WINDOW consecutive words of an item; an item of fewer words is one
window, one of none has none.  Null and empty texts have no words and are not
contaminated; items without an id are ignored, items that share an id count
once; repeated document rows each return a row.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SHARD_WORDS, SAMPLE, BLOCK_BYTES = 13, 300_000, 8, 16 << 20
#: Lower-cases A-Z and turns what is not part of a word into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array by prefix doubling; only tied suffixes are sorted again."""
    n, per = len(text), max(1, 62 // (bits + 1))
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(per, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(per):
        key = key << (bits + 1) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.zeros(n + 1, dtype=np.int64)  # the last is of the empty suffix
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    depth = per
    while len(slots):
        at = order[slots]
        key = rank[at] * (n + 2) + rank[np.minimum(at + depth, n)]
        by = np.argsort(key, kind="stable")
        order[slots] = at = at[by]
        ranked = key[by]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class BitVector:
    """Bits with ranks: words of 64, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        packed = np.zeros(8 * n, dtype=np.uint8)
        made = np.packbits(bits.astype(np.uint8), bitorder="little")
        packed[: len(made)] = made
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """Counts and locates many patterns of symbols 1.. in text; 0 matches nothing."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.append(text + 1, 0).astype(np.int64)  # 0 from here on: the end, which is there once
        symbols += 1
        n, bits = len(text), int(symbols).bit_length()
        order = suffix_order(text, bits)
        bwt = text[order - 1]  # before suffix 0 stands the end
        self.n, self.bits, self.bwt = n, bits, bwt.astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(BitVector(bit))
            self.zeros.append(n - int(bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.base = self._down(np.arange(symbols + 1), np.zeros(symbols + 1, dtype=np.int64))
        sampled = order % sample == 0
        self.sampled, self.position = BitVector(sampled), order[sampled].astype(np.int32)

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            up = ones.rank(at)
            at = np.where((c >> b) & 1 == 1, zeros + up, at - up)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of c in the first `at` symbols of the transform."""
        return self._down(c, at) - self.base[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of those that occur; patterns has one a row."""
        live = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k] + 1
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            found = high > low
            live, low, high = live[found], low[found], high[found]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.zeros(len(rows), dtype=np.int64), 0
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.position[self.sampled.rank(at[done])] + steps
            todo, at = todo[~done], at[~done]
            c = self.bwt[at]
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out


class Windows:
    """The distinct windows of a block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        by: dict[int, list] = {}
        for w, found in owners.items():
            by.setdefault(len(w), []).append((w, tuple(sorted(found))))
        self.by_size = {size: (np.array([w for w, _ in ws], dtype=np.int64), [o for _, o in ws]) for size, ws in sorted(by.items())}

    def find(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """Per document: merged spans of hit words, and the items found."""
        out: list = [([], set()) for _ in docs]
        if not self.by_size or not any(docs):
            return out
        get = self.symbol.get
        text = np.fromiter((s for d in docs for s in (*[get(w, 0) for w in d], 0)), dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
        index = FMIndex(text, len(self.symbol))
        edge = np.zeros(len(text) + 1, dtype=np.int64)
        for size, (patterns, owners) in self.by_size.items():
            which, low, high = index.search(patterns)
            if not len(which):
                continue
            count = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            at = index.locate(rows)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            for d, p in np.unique(np.stack([doc, np.repeat(which, count)], axis=1), axis=0).tolist():
                out[d][1].update(owners[p])
        hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
        change = np.diff(hit)
        for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
            d = int(np.searchsorted(starts, a, side="right")) - 1
            out[d][0].append((a - int(starts[d]), b - int(starts[d])))
        return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Yield (items, whether they are the last) in blocks of at most block_bytes, or of
    one larger item; one block and an item are on the driver at a time."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    block, size = [], 0
    for r in items.orderBy("item", "text").toLocalIterator():
        item = r["item"], bytes(r["text"])
        if block and size + len(item[1]) > block_bytes:
            yield block, False
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    yield block, True


@functools.lru_cache(maxsize=2)
def _windows(key: str, window: int, holder) -> Windows:
    return Windows(holder.items, window)


class _Held:
    """Equal for the cache whatever object carries the block."""

    def __init__(self, items):
        self.items = items

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return isinstance(other, _Held)


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Per row of docs: the columns in carry, n_words, spans (word starts and ends
    in turn) and items."""
    spark = docs.sparkSession
    carry = ["doc_id"] if carry is None else carry
    names = [f"c{i}" for i in range(len(carry))]
    kinds = dict(docs.dtypes)
    body = F.coalesce(docs["text"].cast("string"), F.lit(""))
    state = docs.select(*[docs[c].alias(n) for c, n in zip(carry, names, strict=True)], body.alias("body"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<int>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = ", ".join([*[f"`{n}` {kinds[c]}" for c, n in zip(carry, names, strict=True)], "body string, n_words long, spans array<int>, items array<string>"])
    common.importable(spark)
    for block, last in item_blocks(benchmark, block_bytes):
        key = hashlib.sha256(repr(block).encode()).hexdigest()
        sent = spark.sparkContext.broadcast(block)

        def searched(batches, sent=sent, key=key, last=last):
            common.claim("op6")
            found = _windows(key, window, _Held(sent.value))
            for batch in batches:
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                docs_, spans, items, n_words, size = [], [], [], [], 0

                def flush(docs_=docs_, spans=spans, items=items):
                    for s, i in found.find(docs_):
                        spans.append(s)
                        items.append(i)
                    docs_.clear()

                for t in columns["body"].cast(pa.large_binary()).to_pylist():
                    words = words_of(t)
                    docs_.append(words)
                    n_words.append(len(words))
                    size += len(words) + 1
                    if size >= SHARD_WORDS:
                        flush()
                        size = 0
                flush()
                old_spans, old_items = columns["spans"].to_pylist(), columns["items"].to_pylist()
                merged = [[x for s in merge_spans([*zip(o[::2], o[1::2], strict=True), *new]) for x in s] for o, new in zip(old_spans, spans, strict=True)]
                listed = [sorted({*o, *new}) for o, new in zip(old_items, items, strict=True)]
                columns |= {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(merged, pa.list_(pa.int32())), "items": pa.array(listed, pa.list_(pa.string()))}
                if last:
                    columns["body"] = pa.nulls(batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        state = state.mapInArrow(common.trimmed(searched), schema)
    return state.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "n_words", "spans", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """hit_spans with n_hit, n_items, items_sha256 and contaminated."""
    found = hit_spans(docs, benchmark, window, block_bytes, carry)
    n_hit = F.expr("aggregate(sequence(0, size(spans) div 2), 0L, (a, i) -> a + coalesce(get(spans, 2 * i + 1) - get(spans, 2 * i), 0))")
    return found.withColumn("n_hit", n_hit).withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ","), 256),
            "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
        }
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def oracle_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, size, list_slice(w, s, s + size - 1) AS win FROM (SELECT item, w, least(len(w), {WINDOW}) AS size, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, s, list_slice(w, s, s + size - 1) AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, item, s, dw.size AS size FROM dw JOIN iw USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

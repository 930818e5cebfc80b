"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pending merges of a pre-token are kept in one bucket per merge rank; a bucket
holds positions of a linked list of parts.  A two-level bitmap of 256 x 256 bits marks
ranks with a non-empty bucket, so find-first-set gives the next rank in constant
time; entries whose pair has changed since are stale and skipped when they
come up.  A bucket is put in order of positions when its rank is next and taken
from the left, until a merge makes a pair of a lower rank.  A pre-token of n bytes
costs O(n) queue steps, however long it is, besides that ordering, which finds
positions almost in order.

Pre-tokens repeat, so a worker keeps the ids of those it has seen, within a bound of
entries and of bytes an entry.

Null and empty texts encode to no ids.  Repeated rows each return a row.
"""

from __future__ import annotations

import base64
import functools
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: White space as the tokenizer's regular-expression engine has it (the Unicode property).
SPACE = r"\t-\r \x85\xa0  -     　"
#: Bits of a word of the bitmap, by place.
BIT = [1 << k for k in range(256)]


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s+(?!\S)", f"[{SPACE}]+(?![^{SPACE}])").replace(r"|\s+", f"|[{SPACE}]+"))
        size = max(ranks.values()) + 1
        self.table = [b""] * size
        for piece, rank in ranks.items():
            self.table[rank] = piece
        if size > 256 * len(BIT):
            raise ValueError("the bitmap's two levels hold 65,536 ranks")
        self.memo = common.Memo(self.packed, 700_000, "op8")

    def merge(self, piece: bytes) -> list[int]:
        get, n, longest = self.ranks.get, len(piece), self.longest
        whole = get(piece)
        if whole is not None:
            return [whole]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [-1] * (n + 1)  # the rank of the pair that starts here, -1: none or merged away
        buckets: dict[int, list[int]] = {}  # by rank: positions
        words: dict[int, int] = {}  # bit r & 255 of words[r >> 8]: rank r has a bucket
        top = 0  # the same of words
        todo = []
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                todo.append((r, i))
        while True:
            for r, i in todo:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    high = r >> 8
                    words[high] = words.get(high, 0) | BIT[r & 255]
                    top |= BIT[high]
            if not top:
                break
            high = (top & -top).bit_length() - 1  # find first set, level by level
            bits = words[high]
            rank = high << 8 | (bits & -bits).bit_length() - 1
            bits &= bits - 1
            if bits:
                words[high] = bits
            else:
                del words[high]
                top &= top - 1
            bucket = buckets.pop(rank)
            if len(bucket) > 1:
                bucket.sort()
            todo = []
            for at, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                after[i] = k = after[j]
                before[k] = i
                pair[i] = pair[j] = -1
                lower = False
                if k < n:
                    stop = after[k]
                    if stop - i <= longest and (r := get(piece[i:stop])) is not None:
                        pair[i] = r
                        todo.append((r, i))
                        lower = r <= rank
                h = before[i]
                if h >= 0:
                    pair[h] = -1
                    if k - h <= longest and (r := get(piece[h:k])) is not None:
                        pair[h] = r
                        todo.append((r, h))
                        lower = lower or r <= rank
                if lower:  # the rest of the bucket waits
                    todo += [(rank, x) for x in bucket[at + 1 :] if pair[x] == rank]
                    break
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def packed(self, token: str) -> bytes:
        return array("I", self.merge(token.encode("utf-8", "surrogatepass"))).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, with
    keep_ids the ids as binary (4 bytes each, little-endian), and the columns in
    carry, as they are; those of a result's name are left out."""
    made = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    kept = [c for c in carry or [] if c not in made]
    kinds = dict(docs.dtypes)
    common.importable(docs.sparkSession)

    def encoded(batches):
        common.claim("op8")
        bpe = codec(path, pattern)
        for batch in batches:
            done = 0
            for ids, texts in common.rows([batch]):
                out = [bpe.encode(t.decode("utf-8", "replace")) for t in texts]
                cols = [
                    pa.array(ids, pa.int64()),
                    pa.array([len(x) // 4 for x in out], pa.int64()),
                    pa.array([common.sha(x) for x in out]),
                    pa.array([common.sha(bpe.decode(x)) for x in out]),
                ]
                others = [batch.column(2 + k).slice(done, len(ids)) for k in range(len(kept))]
                done += len(ids)
                yield pa.RecordBatch.from_arrays(cols + [pa.array(out, pa.binary())] * keep_ids + others, names=made + [f"c{k}" for k in range(len(kept))])

    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c].alias(f"c{k}") for k, c in enumerate(kept)])
    out = picked.mapInArrow(common.trimmed(encoded), ", ".join([schema, *[f"c{k} {kinds[c]}" for k, c in enumerate(kept)]]))
    return out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(kept)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_documents(common.table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=False)

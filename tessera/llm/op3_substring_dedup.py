"""Exact substring deduplication by sparse suffix sorting.

A byte goes if a LENGTH-byte string that covers it also starts earlier, in a
smaller doc_id or before in the same document.

1. Anchors.  Of every LENGTH-byte window, the leftmost least hash of its
   GRAM-byte strings is its anchor: a function of the window's bytes, so equal
   windows have equal anchors at equal places.  About one byte in 35 is an
   anchor; the windows of one anchor are consecutive and form its stretch.
2. Anchors are dealt by the hash of their GRAM bytes.  Equal whole stretches are
   copies: all but the first go.  Stretches that share only the anchor are kept
   for step 3, where they may agree in part; a lone anchor is done with.
3. For those the bytes are fetched.  Within an anchor's group, the strings that
   follow it and the reversed ones that precede it are put in suffix order by
   deep-shallow sorting (suffix_sort).  In sorted order, agreement to any depth
   is a matter of the common prefixes of neighbours, so for each place of the
   anchor in the window the first holder of the window is found exactly.
4. Spans are merged per document and the rest is hashed.

Hot strings.  Copies within a batch of documents are settled in the batch, and a
batch sends at most SENT different stretches of one anchor to step 2; more mean
that they belong to step 3 anyway.  A group of over GROUP stretches in step 3 is
not sorted in one task: its windows are dealt by their own hashes instead, where
again a batch sends only its first holder of each.

Null and empty texts have no bytes.  Rows without doc_id come after all others, in
the order of a hash of their texts that stands for the id (62 bits, above NULLS; a
doc_id must lie below it).  Rows that repeat a doc_id and text are one document,
each returning its row; texts that share only the doc_id are told apart by 16 more
bits of a hash of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, suffix_sort

LENGTH, GRAM, SENT, GROUP = 100, 32, 4, 2000
SIDE = LENGTH - GRAM  # windows of an anchor reach so far before and behind it
NULLS = 1 << 62  # ids from here on stand for null ones
NORMAL, EDGE, SPAN = 0, 1, 2
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M2
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of the GRAM bytes at every offset."""
    n = len(data) - 7
    words = np.empty(n, dtype=np.uint64)
    for s in range(8):
        part = np.frombuffer(data, dtype="<u8", offset=s, count=(len(data) - s) // 8)
        words[s::8] = part[: len(words[s::8])]
    m = len(data) - GRAM + 1
    x = np.zeros(m, dtype=np.uint64)
    for j in range(0, GRAM, 8):
        x = mix(x * M1 + words[j : j + m])
    return x


def stretches(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the documents at starts in data: (h, c, doc index, s, i - s, e - s) per
    anchor; windows s..e have the anchor i.  c is of all bytes of the stretch."""
    h = gram_hashes(data)
    bits = max(1, len(data).bit_length())
    low = np.uint64((1 << bits) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, reach = 1, SIDE + 1
    while 2 * width <= reach:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (reach - width)], m[reach - width :])
    anchor = (m & low).astype(np.int64)
    ok = np.zeros(len(data) + 1, dtype=np.int32)
    full = sizes >= LENGTH
    np.add.at(ok, starts[full], 1)
    np.add.at(ok, starts[full] + sizes[full] - LENGTH + 1, -1)
    valid = np.cumsum(ok)[: len(anchor)] > 0
    edge = np.empty(len(anchor), dtype=bool)
    edge[0] = True
    # a document's last window and the next one's first are LENGTH - 1 invalid ones apart
    edge[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    s = np.flatnonzero(edge & valid)
    ends = np.flatnonzero(np.append(edge[1:], True) & valid)
    i = anchor[s]
    last = ends + LENGTH - GRAM
    c = ((ends - s).astype(np.uint64) << np.uint64(8)) | (i - s).astype(np.uint64)
    for j in range(0, 2 * LENGTH, GRAM):
        c = mix(c * M1 + h[np.minimum(s + j, last)])
    doc = np.searchsorted(starts, s, side="right") - 1
    return h[i].view(np.int64), c.view(np.int64), doc, s - starts[doc], i - s, ends - s


def pack(s, mark, off, more):
    """Place of a stretch: its start, 16 bits of the text's hash, anchor offset, further windows."""
    return s << 30 | mark << 14 | off << 7 | more


def number_of(i: int | None, t: bytes) -> int:
    """The doc_id, or one made of the text where there is none."""
    return i if i is not None else NULLS | xxhash.xxh64_intdigest(t, 5) & NULLS - 1


def text_mark(t: bytes) -> int:
    return xxhash.xxh64_intdigest(t, 3) & 0xFFFF


ROW = ["key", "h", "doc", "place"]


def _batch(kind: int, key, h, doc, place) -> pa.RecordBatch:
    cols = [pa.array(np.asarray(x, dtype=np.int64)) for x in (key, h, doc, place)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(cols[0]), kind, dtype=np.int8))], names=[*ROW, "kind"])


def span_rows(doc: np.ndarray, mark: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """Spans, merged where they touch: h holds the end, place the packed start."""
    order = np.lexsort((s, mark, doc))
    doc, mark, s, e = doc[order], mark[order], s[order], e[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
        group = np.cumsum(new)
        top = np.maximum.accumulate(e + group * (1 << 40)) - group * (1 << 40)
        new[1:] |= s[1:] > top[:-1]
        at = np.flatnonzero(new)
        doc, mark, s, e = doc[at], mark[at], s[at], top[np.append(at[1:], len(top)) - 1]
    key = mix(doc.view(np.uint64) * M1 + s.view(np.uint64)).view(np.int64)
    return _batch(SPAN, key, e, doc, pack(s, mark, 0, 0))


def anchors(batches):
    """Step 1, with what a batch can settle by itself."""
    for ids, texts in common.rows(batches, 2 << 20):
        data = b"".join(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not len(sizes) or sizes.max() < LENGTH:
            continue
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        names = np.array([number_of(i, t) for i, t in zip(ids, texts, strict=True)], dtype=np.int64)
        marks = np.array([text_mark(t) for t in texts], dtype=np.int64)
        h, c, d, s, off, more = stretches(data, starts, sizes)
        doc, mark = names[d], marks[d]
        place = pack(s, mark, off, more)
        order = np.lexsort((place, doc, c, h))
        h, c, doc, mark, s, more, place = (x[order] for x in (h, c, doc, mark, s, more, place))
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])
        again = np.concatenate([[False], same[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])])
        copy = same & ~again
        # a row repeated whole is the occurrence itself; one after a first is a copy
        first = np.flatnonzero(~same)
        lead = first[np.cumsum(~same) - 1]
        copy |= again & ~((doc == doc[lead]) & (place == place[lead]))
        yield span_rows(doc[copy], mark[copy], s[copy], (s + more + LENGTH)[copy])
        h, doc, place, c = h[~same], doc[~same], place[~same], c[~same]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        nth = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        most = nth >= SENT
        yield _batch(NORMAL, h[~most], c[~most], doc[~most], place[~most])
        spread = mix(doc.view(np.uint64) * M1 + place.view(np.uint64)).view(np.int64)
        yield _batch(EDGE, spread[most], h[most], doc[most], place[most])


def unpack(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 30, place >> 14 & 0xFFFF, place >> 7 & 127, place & 127


def copies(batches):
    """Step 2, over the anchors of a partition."""
    parts = []
    for b in batches:
        kind = b.column(4).to_numpy()
        normal = kind == NORMAL
        if not normal.all():
            yield b.filter(pa.array(~normal))
        parts.append([b.column(i).to_numpy()[normal] for i in range(4)])
    if not parts:
        return
    h, c, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    again = ranked[1:] == ranked[:-1]
    order = order[np.append(again, False) | np.append(False, again)]
    h, c, doc, place = h[order], c[order], doc[order], place[order]
    order = np.lexsort((place, doc, c, h))
    h, c, doc, place = h[order], c[order], doc[order], place[order]
    if not len(h):
        return
    group = np.concatenate([[True], h[1:] != h[:-1]])
    lead_ = group | np.concatenate([[True], c[1:] != c[:-1]])
    lead = np.flatnonzero(lead_)[np.cumsum(lead_) - 1]
    copy = (doc != doc[lead]) | (place != place[lead])
    s, mark, _, more = unpack(place)
    yield span_rows(doc[copy], mark[copy], s[copy], (s + more + LENGTH)[copy])
    # first holders of stretches, where the anchor has several
    number = np.cumsum(group) - 1
    several = np.bincount(number, weights=lead_) > 1
    pick = lead_ & several[number]
    yield _batch(EDGE, mix(doc.view(np.uint64) * M1 + place.view(np.uint64)).view(np.int64)[pick], h[pick], doc[pick], place[pick])


def finish(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """n_removed, n_spans, kept_sha256."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return sum(b - a for a, b in merged), len(merged), common.sha(b"".join(kept))


def packed_texts(docs: DataFrame) -> DataFrame:
    def packed(batches):
        z = zstandard.ZstdCompressor(level=3)
        for ids, texts in common.rows(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number_of(i, t) for i, t in zip(ids, texts, strict=True)], pa.int64()), pa.array([text_mark(t) for t in texts], pa.int64()), pa.array(ids, pa.int64()), pa.array([z.compress(t) for t in texts], pa.binary())],
                names=["doc", "mark", "doc_id", "z"],
            )

    return common.doc_texts(docs).mapInArrow(packed, "doc long, mark long, doc_id long, z binary")


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
STEP = "kind byte, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, h long, doc long, mark long, place long, bytes binary, spans array<long>"
DONE, PENDING, CONTEXT = 0, 1, 2


def open_texts(batches):
    """Documents without open stretches are finished; of others, the stretches'
    bytes go out, and the text with the spans found so far."""
    z = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in STEP.split(", ")]
    types = [pa.int8(), *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64())]
    for batch in batches:
        out: list[tuple] = []
        for doc, mark, doc_id, packed, spans, edges in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            data, spans, edges = z.decompress(packed), spans or [], edges or []
            if not edges:
                pairs = [(x["s"], x["e"]) for x in spans]
                out.append((DONE, doc_id, len(data), *finish(data, pairs), None, None, None, None, None, None))
                continue
            out.append((PENDING, doc_id, None, None, None, None, None, doc, mark, None, packed, [y for x in spans for y in (x["s"], x["e"])]))
            for x in edges:
                s, more = x["place"] >> 30, x["place"] & 127
                out.append((CONTEXT, None, None, None, None, None, x["h"], doc, mark, x["place"], data[s : s + more + LENGTH], None))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _spans(doc, mark, s, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, mark, s, e)], names=["doc", "mark", "s", "e"])


def sorted_groups(batches):
    """Step 3 for the groups of a partition."""
    parts = [[b.column(i).to_numpy() for i in range(3)] + [np.array(b.column(3).to_pylist(), dtype=object)] for b in batches if b.num_rows]
    if not parts:
        return
    h, doc, place, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    s, mark, off, more = unpack(place)
    order = np.lexsort((mark, s + off, doc, h))
    h, doc, place, text, s, mark, off, more = (x[order] for x in (h, doc, place, text, s, mark, off, more))
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])])
    h, doc, text, s, mark, off, more = (x[~again] for x in (h, doc, text, s, mark, off, more))
    before = np.zeros((len(h), SIDE), dtype=np.uint8)
    after = np.zeros((len(h), SIDE), dtype=np.uint8)
    for k, (t, o) in enumerate(zip(text.tolist(), off.tolist(), strict=True)):
        left, right = t[:o][::-1], t[o + GRAM :][:SIDE]
        before[k, : len(left)] = np.frombuffer(left, dtype=np.uint8)
        after[k, : len(right)] = np.frombuffer(right, dtype=np.uint8)
    group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]]))
    lefts, rights = suffix_sort.deep_shallow(before, group), suffix_sort.deep_shallow(after, group)
    # rows of a group are in the order (doc, anchor), so for one r in the order of their windows
    earliest, latest = np.full(len(h), -1), np.full(len(h), SIDE + 1)
    for r in range(SIDE + 1):
        has = np.flatnonzero((r <= off) & (r >= off - more))
        if len(has) < 2:
            continue
        key = suffix_sort.classes_at(*lefts, r)[has] << 32 | suffix_sort.classes_at(*rights, SIDE - r)[has]
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        lead = first[of]
        dup = has[(doc[has] != doc[has[lead]]) | (s[has] + off[has] != s[has[lead]] + off[has[lead]]) | (mark[has] != mark[has[lead]])]
        earliest[dup] = r
        latest[dup] = np.minimum(latest[dup], r)
    hit = earliest >= 0
    i = s + off
    yield _spans(doc[hit], mark[hit], (i - earliest)[hit], (i - latest + LENGTH)[hit])


def windows(batches):
    """The windows of stretches of overlarge groups: a batch's first holder of each
    goes on, spans of the others are known."""
    for batch in batches:
        w1, w2, doc, mark, at = [], [], [], [], []
        for d, place, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            for p in range(len(t) - LENGTH + 1):
                x = xxhash.xxh3_128_intdigest(t[p : p + LENGTH])
                w1.append((x >> 64) - (1 << 63))
                w2.append((x & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                doc.append(d)
                mark.append(place >> 14 & 0xFFFF)
                at.append((place >> 30) + p)
        yield from first_holders([pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (w1, w2, doc, mark, at)], names=["w1", "w2", "doc", "mark", "at"])])


def first_holders(batches, firsts: bool = True):
    parts = [[b.column(i).to_numpy() for i in range(5)] for b in batches if b.num_rows]
    if not parts:
        return
    w1, w2, doc, mark, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((mark, at, doc, w2, w1))
    w1, w2, doc, mark, at = (x[order] for x in (w1, w2, doc, mark, at))
    new = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    dup = (doc != doc[lead]) | (at != at[lead]) | (mark != mark[lead])
    names = ["w1", "w2", "doc", "mark", "at", "e"]
    spans = _spans(doc[dup], mark[dup], at[dup], at[dup] + LENGTH)
    if not firsts:
        yield spans
        return
    none = pa.nulls(spans.num_rows, pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, *[spans.column(i) for i in range(4)]], names=names)
    yield pa.RecordBatch.from_arrays([pa.array(x[new], pa.int64()) for x in (w1, w2, doc, mark, at)] + [pa.nulls(int(new.sum()), pa.int64())], names=names)


def closed_texts(batches):
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for doc_id, packed, old, new in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data, old = z.decompress(packed), old or []
            spans = [*zip(old[::2], old[1::2], strict=True), *((x["s"], x["e"]) for x in new or [])]
            out.append((doc_id, len(data), *finish(data, spans)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 4, pa.string()], strict=True)], names=RESULT)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    rows = "key long, h long, doc long, place long, kind byte"
    found = common.doc_texts(docs).mapInArrow(anchors, rows)
    found = common.materialize(common.spread(found, "key").mapInArrow(copies, rows).select("h", "doc", "place", "kind"), "anchors")
    mark = F.shiftright("place", 14).bitwiseAND(F.lit(0xFFFF)).alias("mark")
    marked = found.withColumn("mark", mark)
    pair = F.struct(F.shiftright("place", 30).alias("s"), F.col("h").alias("e"))
    per_doc = marked.groupBy("doc", "mark").agg(
        F.collect_list(F.when(F.col("kind") == SPAN, pair)).alias("spans"),
        F.collect_list(F.when(F.col("kind") == EDGE, F.struct("place", "h"))).alias("edges"),
    )
    step = packed_texts(docs).join(per_doc, ["doc", "mark"], "left").select("doc", "mark", "doc_id", "z", "spans", "edges").mapInArrow(open_texts, STEP)
    step = common.materialize(step, "contexts")
    context = step.where(F.col("kind") == CONTEXT).select("h", "doc", "place", "bytes")
    large = context.groupBy("h").count().where(F.col("count") > GROUP).select("h", F.lit(1).alias("large"))
    sized = context.withColumnRenamed("bytes", "b").join(large, "h", "left")
    span = "doc long, mark long, s long, e long"
    small = common.spread(sized.where("large IS NULL").select("h", "doc", "place", "b"), "h").mapInArrow(sorted_groups, span)
    dealt = sized.where("large = 1").select("h", "doc", "place", "b").mapInArrow(windows, "w1 long, w2 long, doc long, mark long, at long, e long")
    dealt = common.materialize(dealt, "windows")
    settled = dealt.where("e IS NOT NULL").select("doc", "mark", F.col("at").alias("s"), "e")
    firsts = common.spread(dealt.where("e IS NULL").select("w1", "w2", "doc", "mark", "at"), "w1").mapInArrow(lambda b: first_holders(b, False), span)
    more = small.union(settled).union(firsts).groupBy("doc", "mark").agg(F.collect_list(F.struct("s", "e")).alias("more"))
    pending = step.where(F.col("kind") == PENDING).select("doc", "mark", "doc_id", F.col("bytes").alias("z"), "spans")
    closed = pending.join(more, ["doc", "mark"], "left").select("doc_id", "z", "spans", "more").mapInArrow(closed_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return step.where(F.col("kind") == DONE).select(*RESULT).union(closed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(common.table(spark, sf_dir, "documents"))

"""Personal data: candidate spans scored by gradient-boosted trees.

Base kinds (email, ip, card, phone) are found by fixed patterns and validators
and always stay.  High-recall generators propose further, overlapping spans:
digit groups (number), spelled-out addresses (contact), and long mixed tokens
(secret).  Boosted trees score them by format and by the words and signs around
them; isotonic calibration turns scores into probabilities, and the redaction
threshold per kind is the lowest that reaches `precision` on held-out spans (no
threshold: the kind adds nothing).  Of added spans that overlap, the likeliest stays;
one that overlaps a base span goes.

No table labels spans, so labelled ones are planted: formats of private and of
harmless spans (planting) are put, with a context, into the texts of the corpus at
drawn places, and what the generators propose there takes the label of what was
planted.  What is planted depends on doc_id alone.  The trees are fitted on the
plantings of at most `sample_docs` documents outside the held-out third, those with
the smallest hash of doc_id, and on at most `sample_rows` candidates, a documented
bound; calibration and thresholds count the plantings in every held-out document,
and spans are searched in whole texts of all documents.  A kind with fewer than
FEW held-out candidates takes the threshold of all kinds together.

Null and empty texts have no spans.  Repeated rows each return a row.  Without any
document with an id no trees are fitted and only base spans are found; an empty
table returns no rows.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, planting
from .boosting import Boosted

SAMPLE_DOCS, SAMPLE_ROWS, PRECISION = 4000, 20_000, 0.9
STEPS, FEW = 64, 20
TRAIN_PLANTS, HELD_PLANTS = 6, 2
BASE = ("email", "ip", "card", "phone")
MORE = ("contact", "number", "secret")

# The base patterns.  A possessive run that starts where no digit stands before it
# matches what a plain one does, without its quadratic time on long runs.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What follows the local part of a spelled-out address.
AT = re.compile(r" ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)+")
NUMBER = re.compile(r"[0-9](?:[ .()-]{0,2}[0-9]){6,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile("[0-9]")

#: Groups of words that may stand before a span; what they mean is learned.
CUES = tuple(
    re.compile(rf"(?<![a-z])(?:{words})")
    for words in (
        "token|secret|passw|pwd|passphrase|api|access|auth|credential|bearer|private|login|key",
        "tel|phone|call|mobil|cell|fax|whatsapp|ring|dial|sms|handy|reach|hotline|portable|móvil",
        "ssn|social|iban|account|passport|konto|tax|patient|licen[cs]e no",
        "mail|write|contact|address|schreib|correo|courriel",
        "commit|sha|md5|checksum|hash|digest|etag|revision|build|blob|uuid|object",
        "order|invoice|isbn|ticket|article|part|serial|item|page|version|ref|nr|no|number|population|lot|doi|size|time|date",
    )
)
BEFORE, AFTER = 32, 8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def before_at(text: str, at: int, low: int) -> int:
    """Where the run of a local part that ends at `at` starts, not before low."""
    while at > low and text[at - 1] in LOCAL:
        at -= 1
    return at


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping: the local part is all of the run before an @
    that follows the last match."""
    out, low = [], 0
    for m in DOMAIN.finditer(text):
        start = before_at(text, m.start(), low)
        if start < m.start():
            out.append((start, m.end()))
            low = m.end()
    return out


def octet(part: str) -> bool:
    """A part of an address, of any number of digits, is at most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(octet, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    out, low = [], 0
    for m in AT.finditer(text) if "at" in text or "AT" in text else ():
        start = before_at(text, m.start(), low)
        if start < m.start():
            out.append(("contact", start, m.end()))
            low = m.end()
    out += [("number", m.start(), m.end()) for m in NUMBER.finditer(text)]
    out += [("secret", m.start(), m.end()) for m in TOKEN.finditer(text) if DIGIT.search(m.group())]
    return out


NAMES = [
    "kind", "size", "digits", "digit_share", "letter_share", "upper_share", "distinct_share", "distinct", "spaces", "dots", "hyphens", "brackets", "underscores", "slashes", "equals",
    "turns", "longest_letters", "hexadecimal", "groups", "first_group", "last_label", "plus_before", "blank_before", "quote_before", "sign_before", "word_before", "word_after", "quote_after",
    *(f"cue_{i}" for i in range(len(CUES))),
]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span, and signs and words beside it."""
    s, before, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    n, low = len(s), before.lower()
    digits, upper, letters = sum(c.isdigit() for c in s), sum(c.isupper() for c in s), sum(c.isalpha() for c in s)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    groups = re.split("[^0-9A-Za-z]+", s)
    bare = s.rstrip(" ")
    near = low.rstrip(" \"'")
    return [
        MORE.index(kind), n, digits, digits / n, letters / n, upper / n, len(set(s)) / n, len(set(s)), s.count(" "), s.count("."), s.count("-"), s.count("("), s.count("_"), s.count("/"), s.count("="),
        turns / n, max(map(len, re.split("[^A-Za-z]+", s))), float(not bare.strip("0123456789abcdefABCDEF")), len(groups), len(groups[0]), len(groups[-1]),
        float(before[-1:] == "+"), float(before[-1:] in ("", " ", "\n")), float(before[-1:] in ("\"", "'")), float(near[-1:] in ("=", ":")), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in ("\"", "'")),
        *(float(bool(cue.search(low))) for cue in CUES),
    ]


def _overlaps(spans: list, start: int, end: int) -> bool:
    return any(a < end and start < b for _, a, b in spans)


class Redactor:
    """Trees with calibrated thresholds per kind; without trees only base spans."""

    def __init__(self, trees: Boosted | None = None, thresholds: dict[str, float] | None = None):
        self.trees, self.thresholds = trees, thresholds or {}

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        if self.trees is None:
            return []
        found = [c for c in candidates(text) if c[0] in self.thresholds and not _overlaps(base, c[1], c[2])]
        if not found:
            return []
        p = self.trees.probability(np.array([features(text, *c) for c in found]))
        out: list[tuple[str, int, int]] = []
        for q, c in sorted(zip(p, found, strict=True), key=lambda x: (-x[0], x[1])):
            if q >= self.thresholds[c[0]] and not _overlaps(out, c[1], c[2]):
                out.append(c)
        return sorted(out)


def is_held(doc_id: int) -> bool:
    return hash((doc_id, 7)) % 3 == 0


def planted_candidates(doc_id: int, text: str, count: int) -> list[tuple[int, list[float]]]:
    """(label, features) of what the generators propose at `count` drawn places of a
    text, each with something planted there."""
    rng, out = random.Random(doc_id), []
    for _ in range(count):
        kind, private, before, span, after = planting.draw(rng)
        at = text.find(" ", rng.randrange(len(text))) if text else 0
        at = len(text) if at < 0 else at
        left = text[max(0, at - BEFORE) : at] + " " + before
        whole = left + span + after + text[at : at + BEFORE]
        base = base_spans(whole)
        for c in candidates(whole):
            if c[1] < len(left) + len(span) and len(left) < c[2] and not _overlaps(base, c[1], c[2]):
                out.append((int(private and c[0] == kind), features(whole, *c)))
    return out


def sampled_candidates(docs: DataFrame, sample_docs: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the plantings in a bounded sample of documents."""
    picked = docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sampled = docs.join(F.broadcast(picked.distinct()), "doc_id").select("doc_id", "text")

    def made(batches):
        for ids, texts in common.rows(batches):
            out = [(i, *c) for i, t in zip(ids, texts, strict=True) if not is_held(i) for c in planted_candidates(i, t.decode("utf-8", "replace"), TRAIN_PLANTS)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    found = sampled.mapInArrow(made, "doc_id long, label long, x array<double>")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(sample_rows).collect()
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(len(got), len(NAMES))
    return x, np.array([r["label"] for r in got], dtype=np.float64)


def score_histogram(docs: DataFrame, trees: Boosted) -> np.ndarray:
    """Rows (kind, margin, positive, count) over the plantings in all held-out
    documents; margins are rounded up to 1/STEPS, so few rows reach the driver."""

    def counted(batches):
        for ids, texts in common.rows(batches):
            found = [c for i, t in zip(ids, texts, strict=True) if is_held(i) for c in planted_candidates(i, t.decode("utf-8", "replace"), HELD_PLANTS)]
            x = np.array([c[1] for c in found], dtype=np.float64).reshape(len(found), len(NAMES))
            bins = np.ceil(trees.margin(x) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int64)), pa.array(bins), pa.array([c[0] for c in found], pa.int64())], names=["kind", "bin", "label"])

    made = docs.where("doc_id IS NOT NULL").mapInArrow(counted, "kind long, bin long, label long")
    got = made.groupBy("kind", "bin").agg(F.sum("label").alias("positive"), F.count("*").alias("n")).orderBy("kind", "bin").collect()
    return np.array([(r["kind"], r["bin"] / STEPS, r["positive"], r["n"]) for r in got], dtype=np.float64).reshape(len(got), 4)


def lowest(p: np.ndarray, positive: np.ndarray, count: np.ndarray, precision: float) -> float | None:
    for t in np.unique(p):
        if positive[p >= t].sum() >= precision * count[p >= t].sum():
            return max(0.5, float(t))
    return None


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> Redactor:
    docs = common.doc_texts(docs)
    x, y = sampled_candidates(docs, sample_docs, sample_rows)
    if not len(y) or y.min() == y.max():
        return Redactor()
    trees = Boosted().fit(x, y)
    kinds, margins, positive, count = score_histogram(docs, trees).T
    if not len(kinds):
        return Redactor()
    trees.calibrate_counts(margins, positive, count)
    p, thresholds = trees.calibrated(margins), {}
    for k, kind in enumerate(MORE):
        at = kinds == k
        if count[at].sum() < FEW:
            at = np.ones(len(kinds), dtype=bool)
        t = lowest(p[at], positive[at], count[at], precision)
        if t is not None:
            thresholds[kind] = t
    return Redactor(trees, thresholds)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, low = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= low:
            continue
        if a >= low:
            out += [text[low:a], f"[{kind}]"]
        low = b
    return "".join(out) + text[low:]


def find_pii(docs: DataFrame, model: Redactor | None = None, keep_text: bool = True) -> DataFrame:
    """Per row of docs: counts and spans, and with keep_text the redacted text."""
    docs = common.doc_texts(docs)
    model = fit(docs) if model is None else model

    def found(batches):
        for ids, texts in common.rows(batches):
            cols: list[list] = [[] for _ in range(7)]
            for t in texts:
                text = t.decode("utf-8", "replace")
                base = base_spans(text)
                spans = base + model.added(text, base)
                for c, k in enumerate(BASE):
                    cols[c].append(sum(s[0] == k for s in base))
                cols[4].append(common.sha(joined(base).encode()))
                cols[5].append(joined(spans))
                if keep_text:
                    cols[6].append(redact(text, spans))
            arrays = [pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())]
            names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[6], pa.string())] * keep_text, names=names + ["redacted"] * keep_text)

    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string" + ", redacted string" * keep_text
    return docs.mapInArrow(found, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(common.table(spark, sf_dir, "documents"), keep_text=False)

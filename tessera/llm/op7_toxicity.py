"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all documents.  Tokens that look
obfuscated (letters mixed with look-alike signs, letters repeated, words spelled
with spaces or separators) become a lattice: every sign may stand for itself, for
the letters it resembles, or for nothing where it separates or repeats.  Viterbi
finds the letters that the channel's costs and the language model like best; the
restored words replace the token.  Tokens and spelled-out runs are decoded whole,
however long; a run counts as one word and as the words it falls into.

A logistic model scores the restored words and their openings.  It is fitted on
at most SAMPLE labelled documents of either label with the smallest hash of
doc_id, a documented bound, never on a held-out fold (crc32 of doc_id mod 5 is
0).  Its features are the FEATURES words and openings most associated with the
label in that sample.  doc_id, lang, source and labels are no inputs of a score.

Null and empty texts score as texts without any feature.  A document labelled
more than once counts as toxic if one label says so.  Without labels of both
kinds the score is the prior.  Repeated rows each return a row; rows without
doc_id are not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, FEATURES, LEAST_Z = 5000, 600, 4.5
OPENINGS = (4, 5, 6)

# Signs and the letters they resemble.
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = frozenset(" .-_*~'`")
SUBSTITUTE, SEPARATE, COLLAPSE = -1.5, -0.5, -1.0
#: Symbols of the language model: 0 is a word's edge, then letters of Latin-1.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}
SIZE = len(LETTERS) + 1
CODES = np.array([SYMBOL.get(bytes([b]).decode("latin-1"), 0) for b in range(256)], dtype=np.int64)

SPELLED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*][^\W_]){2,}(?!\S)")
MIXED = re.compile(r"[a-zß-ÿ]")
SIGN = re.compile(r"[0-9@$!|+(€£.\-_*~'`]")
REPEATED = re.compile(r"([a-zß-ÿ])\1\1")
EDGE = ".,;:!?\"'()[]{}<>#*%&-_~`|=+/\\"


class CharacterModel:
    """Trigram log probabilities, interpolated with bigrams and unigrams."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        two, one = c.sum(axis=0), c.sum(axis=(0, 1))
        uni = (one + 1) / (one.sum() + SIZE)
        bi = (two + 5 * uni) / (two.sum(axis=1, keepdims=True) + 5)
        tri = (c + 5 * bi[None]) / (c.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(tri).tolist()

    def decode(self, token: str, breaks: bool = False) -> str:
        """The best letters for an obfuscated token (Viterbi over the lattice); with
        breaks, a separator may also end a word, which a space then shows."""
        states = {(0, 0): (0.0, None)}  # last two symbols -> best score and letters, linked from the last
        last = ""
        for sign in token:
            options = [(sign, SYMBOL[sign], 0.0)] if sign in SYMBOL else []
            options += [(c, SYMBOL[c], SUBSTITUTE) for c in LOOKALIKE.get(sign, "")]
            skip = SEPARATE if sign in SEPARATORS else COLLAPSE if sign == last and sign in SYMBOL else None
            if not options and skip is None:
                skip = SUBSTITUTE
            if breaks and sign in SEPARATORS:
                options.append((" ", 0, 0.0))
            fresh: dict = {}
            for (a, b), (score, letters) in states.items():
                if skip is not None and score + skip > fresh.get((a, b), (-math.inf,))[0]:
                    fresh[a, b] = (score + skip, letters)
                for c, s, cost in options:
                    total = score + cost + self.log[a][b][s]
                    if total > fresh.get((b, s), (-math.inf,))[0]:
                        fresh[b, s] = (total, (letters, c))
            states, last = fresh, sign
        ends = [(score + self.log[a][b][0], letters) for (a, b), (score, letters) in states.items()]
        best = max(score for score, _ in ends)
        return max(unlinked(letters) for score, letters in ends if score == best)


def unlinked(letters: tuple | None) -> str:
    out = []
    while letters is not None:
        letters, c = letters
        out.append(c)
    return "".join(reversed(out))


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts over all documents; at most SIZE^3 sums reach the driver."""

    def counted(batches):
        common.claim("op7")
        for _, texts in common.rows(batches):
            total = np.zeros(SIZE**3, dtype=np.int64)
            for t in texts:
                s = CODES[np.frombuffer(t.decode("utf-8", "replace").lower().encode("latin-1", "replace"), dtype=np.uint8)]
                s = np.concatenate([[0, 0], s, [0]])
                code = (s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:]
                code = code[(s[1:-1] > 0) | (s[2:] > 0)]
                total += np.bincount(code, minlength=SIZE**3)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    sums = common.doc_texts(docs).mapInArrow(common.trimmed(counted), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE**3, dtype=np.int64)
    for r in sums.toLocalIterator():
        out[r["code"]] = r["n"]
    return out


class Restorer:
    def __init__(self, model: CharacterModel):
        self.model = model

    def word(self, token: str) -> str:
        """A token without its edge punctuation, restored if it looks obfuscated."""
        core = token.strip(EDGE)
        outer = token.strip(".,;:?\"'[]{}<>#*%&-_~`=/\\")
        if 2 < len(outer) and MIXED.search(outer):
            inner = outer.rstrip("!") if not SIGN.search(outer.rstrip("!")) else outer
            if SIGN.search(inner) or REPEATED.search(inner):
                return self.model.decode(inner)
        return core

    def spelled(self, text: str) -> list[str]:
        """Every spelled-out run as one word, and the words it falls into."""
        runs = [m.group() for m in SPELLED.finditer(text)]
        return [w for run in runs for w in dict.fromkeys([self.model.decode(run), *self.model.decode(run, True).split()])]


def features_of(word: str) -> list[str]:
    if len(word) < 3:
        return []
    return [f"={word}", *[word[:k] for k in OPENINGS if len(word) > k]]


def document_features(text: str, restorer: Restorer, words: dict) -> set[str]:
    text = text.lower()
    out: set[str] = set()
    for token in set(text.split()):
        out.update(words[token])
    for w in restorer.spelled(text):
        out.update(features_of(w))
    return out


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Scorer:
    """Logistic model over selected features of restored texts."""

    def __init__(self, counts: np.ndarray, weights: dict[str, float], bias: float):
        self.counts, self.weights, self.bias = counts, weights, bias
        self.restorer = None

    def __getstate__(self):
        at = np.flatnonzero(self.counts)
        return at, self.counts[at], self.weights, self.bias

    def __setstate__(self, state):
        self.counts = np.zeros(SIZE**3, dtype=np.int64)
        self.counts[state[0]] = state[1]
        self.weights, self.bias, self.restorer = state[2], state[3], None

    def score(self, text: str) -> float:
        if self.restorer is None:
            self.restorer = Restorer(CharacterModel(self.counts))
            known = self.weights
            # most words have no selected feature
            self.words = common.Memo(lambda token: tuple(f for f in features_of(self.restorer.word(token)) if f in known), 200_000, "op7")
        found = {f for f in document_features(text, self.restorer, self.words) if f in self.weights}
        x = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `most` documents of either label, out of the training folds."""
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    given = given.where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = given.where("toxic = 1").orderBy(*order).limit(most).union(given.where("toxic = 0").orderBy(*order).limit(most))
    texts = common.doc_texts(docs).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy(F.xxhash64("text")).agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))  # copies would count as evidence
    return common.materialize(texts.select("text", "toxic"), "toxic-sample")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.03) -> tuple[np.ndarray, float]:
    """Newton steps with a ridge on the weights, not on the bias."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x
        h[np.diag_indices_from(h)] += penalty
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> Scorer:
    counts = trigram_counts(docs)
    texts = labelled_sample(docs, labels, sample)
    total = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    prior = (pos + 0.5) / (pos + neg + 2)
    none = Scorer(counts, {}, math.log(min(prior, 0.4) / (1 - min(prior, 0.4))))
    if not pos or not neg:
        return none

    def counted(batches):
        common.claim("op7")
        restorer = Restorer(CharacterModel(counts))
        words = common.Memo(lambda token: tuple(features_of(restorer.word(token))), 200_000, "op7")
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(document_features(text or "", restorer, words))
            names = sorted(set(seen[0]) | set(seen[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], names=["f", "a", "b"])

    sums = texts.mapInArrow(common.trimmed(counted), "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # pooled two-proportion statistic of the shares of toxic and of other documents that hold the feature
    share = (F.col("a") + F.col("b")) / F.lit(pos + neg)
    spread = F.sqrt(share * (1 - share) * F.lit(1 / pos + 1 / neg))
    z = F.when(spread > 0, (F.col("a") / F.lit(pos) - F.col("b") / F.lit(neg)) / spread).otherwise(0.0)
    chosen = [r["f"] for r in sums.where("a >= 4").withColumn("z", z).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "f").limit(most).collect()]
    if not chosen:
        return none
    at = {f: i for i, f in enumerate(sorted(chosen))}

    def marked(batches):
        restorer = Restorer(CharacterModel(counts))
        words = common.Memo(lambda token: tuple(f for f in features_of(restorer.word(token)) if f in at), 300_000, "op7")
        for batch in batches:
            found = [sorted(at[f] for f in document_features(t or "", restorer, words) if f in at) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "x"])

    got = texts.mapInArrow(common.trimmed(marked), "toxic int, x array<int>").collect()
    x, y = np.zeros((len(got), len(at)), dtype=np.float32), np.array([r["toxic"] for r in got], dtype=np.float64)
    for i, r in enumerate(got):
        x[i, r["x"]] = 1
    order = np.lexsort((*x.T[:8], x.sum(axis=1), y))  # sums don't depend on the order of rows then
    weights, bias = _logistic(x[order], y[order])
    # the sample holds the labels in other shares than the corpus; the bias stays that of the sample, where 0.5 splits them
    return Scorer(counts, {f: float(weights[i]) for f, i in at.items()}, bias)


def scored(docs: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """The columns in keep as c0, c1 and so on, and score (0 to 1) and predicted, per row of docs."""
    kinds = dict(docs.dtypes)
    common.importable(docs.sparkSession)
    picked = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("body"), *[docs[c].alias(f"c{i}") for i, c in enumerate(keep)])
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def made(batches):
        common.claim("op7")
        model = sent.value
        for batch in batches:
            s = []
            for start in range(0, batch.num_rows, 500):  # few texts as Python strings at a time
                s += [model.score(t) for t in batch.column(0).slice(start, 500).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=[*batch.schema.names[1:], "score", "predicted"])

    return picked.mapInArrow(common.trimmed(made), ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(keep)], "score double, predicted int"]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted per row of docs."""
    plain = common.doc_texts(docs)
    return scored(plain, fit(docs, labels), ["doc_id"]).select(F.col("c0").alias("doc_id"), held_out(F.col("c0")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; same columns, whatever their names."""
    kept = scored(docs, fit(docs, labels), docs.columns).where("predicted = 0")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

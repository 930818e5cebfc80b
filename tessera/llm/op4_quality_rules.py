"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose statistic exceeds a cutoff.  Cutoffs are chosen
on the labelled holdout: per rule and stratum, good texts (quality 1) are
counted in a fixed grid, and the grid is walked from loose to strict for as
long as the exact (Clopper-Pearson) upper bound of the false-rejection rate
stays within the rule's share of `risk`.  The walk is a fixed-sequence test;
across rules and strata the confidence is Bonferroni-corrected.  A stratum with
too few good labels certifies no cutoff, so nothing is rejected there: with six
rules, four strata and no rejection at all, 1,850 good labels certify.

All statistics cover whole texts and all documents.  Only the histogram of good
labels, rules x strata x grid, reaches the driver.  Null and empty texts have no
words, hence fail the base rule.  Repeated rows each return a row; a document
labelled more than once counts with its lowest quality.  The stratum is `lang`;
beyond the `strata` most labelled values (ties by value), the rest share one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RISK, CONFIDENCE, STRATA = 0.02, 0.95, 64
WINDOW = 5
OTHER = "\x00other"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_word_lines long"


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


#: Statistic of each rule (larger is worse) and the grid of its cutoffs, loosest first.
RULES: dict[str, tuple[Column | object, list[float]]] = {
    "symbols": (lambda: _ratio("n_symbols", "word_chars"), [i / 200 for i in range(100, 0, -1)]),
    "upper": (lambda: _ratio("n_upper", "word_chars"), [i / 100 for i in range(99, 4, -1)]),
    "repeats": (lambda: _ratio("n_repeat_words", "n_words"), [i / 100 for i in range(99, 1, -1)]),
    "dup_lines": (lambda: _ratio("n_dup_lines", "n_word_lines"), [i / 100 for i in range(99, 1, -1)]),
    "long_words": (lambda: _ratio("word_chars", "n_words"), [i / 4 for i in range(80, 20, -1)]),
    "short_words": (lambda: -_ratio("word_chars", "n_words"), [-i / 4 for i in range(4, 20)]),
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside a WINDOW-word window found twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=n)
    m = n - WINDOW + 1
    key = np.zeros(m, dtype=np.uint64)
    exact = len(seen) ** WINDOW < 1 << 63
    factor = np.uint64(len(seen) if exact else 0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        key = key * factor + ids[k : k + m]
        if not exact:
            key ^= key >> np.uint64(29)
            key *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key, kind="stable")
    equal = np.diff(key[order]) == 0
    if not equal.any():
        return 0
    twice = np.zeros(m, dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[:m] += twice
    edge[WINDOW : WINDOW + m] -= twice
    return int((np.cumsum(edge[:n]) > 0).sum())


def text_stats(data: bytes) -> tuple[int, ...]:
    words = data.split()  # of bytes: splits at exactly space and 0x09-0x0D
    solid = b"".join(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(solid.decode("utf-8", "replace")),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(solid) - len(solid.translate(None, UPPER)),
        len(lines),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the statistics of every row of docs."""
    names = [x.split()[0] for x in STATS.split(", ")]

    def counted(batches):
        for batch in batches:
            lang = batch.column(2)
            done = 0
            for ids, texts in common.rows([batch]):
                cols = zip(*map(text_stats, texts), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lang.slice(done, len(ids)), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "stratum", *names])
                done += len(ids)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    return picked.mapInArrow(counted, f"doc_id long, stratum string, {STATS}")


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(x, a, b) / a
    return 1 - front * _beta_fraction(1 - x, b, a) / b


def binomial_cdf(k: int, n: int, p: float) -> float:
    """In closed form, so its cost doesn't grow with the labels."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    return min(1.0, incomplete_beta(1 - p, n - k, k + 1))


def certified(rejected: int, good: int, risk: float, delta: float) -> bool:
    """The exact upper confidence bound (at 1 - delta) of the rate is within risk."""
    return good > 0 and rejected <= risk * good and binomial_cdf(rejected, good, risk) <= delta


def select_cutoffs(counts: dict[str, dict[str, dict[int, int]]], risk: float, confidence: float) -> dict[str, dict[str, float]]:
    """counts[rule][stratum][first grid step that rejects the text] -> texts.
    Returns cutoffs[rule][stratum], certified jointly at the confidence."""
    tests = sum(len(s) for s in counts.values())
    out: dict[str, dict[str, float]] = {}
    for rule, strata in counts.items():
        grid = RULES[rule][1]
        for stratum, at in strata.items():
            good, rejected, best = sum(at.values()), 0, None
            for i, cutoff in enumerate(grid):
                rejected += at.get(i, 0)
                if not certified(rejected, good, risk / len(RULES), (1 - confidence) / max(1, tests)):
                    break
                best = cutoff
            if best is not None:
                out.setdefault(rule, {})[stratum] = best
    return out


def learn_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE, strata: int = STRATA) -> tuple[dict, list[str]]:
    lowest = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    good = stats.join(lowest.where("quality = 1").select("doc_id"), "doc_id")
    top = [r["stratum"] for r in good.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(strata).collect()]
    stratum = F.when(F.col("stratum").isin(top), F.col("stratum")).otherwise(F.lit(OTHER)) if top else F.lit(OTHER)
    steps = []
    for rule, (stat, grid) in RULES.items():
        value = stat()
        # step i rejects values over grid[i]; the grid falls evenly, so the first such step is a division away
        gap = grid[0] - grid[1]
        first = F.greatest(F.lit(0), F.floor((F.lit(grid[0]) - value) / F.lit(gap) + F.lit(1e-9)).cast("int") + 1)
        first = F.when(value > F.lit(grid[0]), F.lit(0)).otherwise(first)
        steps.append(F.struct(F.lit(rule).alias("rule"), F.least(first, F.lit(len(grid))).alias("step")))
    counted = good.select(stratum.alias("stratum"), F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "s.rule", "s.step").count()
    counts: dict = {rule: {} for rule in RULES}
    for r in counted.collect():
        counts[r["rule"]].setdefault(r["stratum"], {})[r["step"]] = r["count"]
    return select_cutoffs(counts, risk, confidence), top


def judge(stats: DataFrame, cutoffs: dict, top: list[str]) -> DataFrame:
    stratum = F.when(F.col("stratum").isin(top), F.col("stratum")).otherwise(F.lit(OTHER)) if top else F.lit(OTHER)
    failed = F.lit(False)
    for rule, by in cutoffs.items():
        table = F.create_map(*[F.lit(x) for pair in by.items() for x in pair])
        failed = failed | F.coalesce(RULES[rule][0]() > F.try_element_at(table, stratum) + F.lit(1e-9), F.lit(False))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumns({"base_failed": base, "kept": ~base & ~failed})


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    stats = common.materialize(statistics(docs), "quality")
    cutoffs, top = learn_cutoffs(stats, labels, risk, confidence)
    return judge(stats, cutoffs, top).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

"""License scan by an exact set-similarity join, in DataFrame functions only.

Template tokens are ordered by how many documents of the corpus hold them,
rarest first.  A block, a run of RUN lines from every line on, so that a licence
wrapped over lines stands in one, that holds at least THRESHOLD of a template's
distinct tokens must hold one of the template's |T| - need + 1 rarest, so only
those prefixes are indexed.  A block joins the index on its tokens; the length
filter drops blocks with fewer template tokens than needed, the positional
filter those whose remaining tokens can't reach the overlap any more, and the
survivors are verified on whole sets.  The index is as large as the constant
template list, so broadcasting it doesn't grow with the data.

The base scan finds the places of fixed phrases in the whole word sequence.

Null and empty texts have no words.  Rows that share a doc_id share the labels
of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD, RUN = 0.8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the base scan.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Opening sentences of public licences and usual short notices.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2.0",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "licensed under cc by nc 4.0",
    "cc-by-notice": "licensed under a creative commons attribution 4.0 international license",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license",
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_tokens(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    return {k: sorted(set(re.findall(WORD, v.lower()))) for k, v in templates.items()}


def needed(size: int, threshold: float) -> int:
    """Least overlap; in hundredths, to keep to whole numbers."""
    return -(-size * round(100 * threshold) // 100)


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase; the scan by position runs only where the joined words hold it."""
    parts = phrase.split()
    held = F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {phrase} "))

    def starts(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            found = found & (F.coalesce(F.get(words, i + k), F.lit("")) == p)
        return found

    every = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.when(held, F.filter(every, starts)).otherwise(F.expr("array()").cast("array<int>"))


def base_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels)."""
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    placed = worded.select("doc_id", F.size("words").cast("long").alias("n_words"), *[_places(F.col("words"), p).alias(f"p_{k}") for k, p in phrases.items()])
    every = F.concat(*[F.col(f"p_{k}") for k in phrases])
    return placed.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.filter(F.array(*[F.when(F.size(f"p_{k}") > 0, F.lit(k)) for k in phrases]), lambda x: x.isNotNull()).alias("base"),
    )


def frequency_order(docs: DataFrame, tokens: list[str]) -> list[str]:
    """Template tokens by document frequency over all documents, rarest first.
    What reaches the driver is bounded by the template list."""
    listed = F.array(*map(F.lit, tokens))
    counted = docs.select(F.explode(F.array_intersect(listed, words_of(F.col("text")))).alias("token")).groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counted.collect()}
    return sorted(tokens, key=lambda t: (seen.get(t, 0), t))


def template_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line, label, overlap, containment) of every block, by its first line,
    and template whose containment |block & template| / |template| reaches threshold."""
    spark = docs.sparkSession
    sets = template_tokens(templates)
    order = frequency_order(docs, sorted(set().union(*sets.values())))
    at = {t: i for i, t in enumerate(order)}
    index, prefixes = [], set()
    for label, tokens in sets.items():
        ranked = sorted(tokens, key=at.__getitem__)
        need = needed(len(ranked), threshold)
        for i, t in enumerate(ranked[: len(ranked) - need + 1]):
            index.append((t, label, i, len(ranked), need, ranked))
            prefixes.add(t)
    indexed = spark.createDataFrame(index, "token string, label string, t_pos int, t_size int, need int, t_tokens array<string>")
    listed = F.array(*map(F.lit, order))
    rare = F.array(*[F.lit(t) for t in order if t in prefixes])
    blocks = (
        docs.where(F.arrays_overlap(rare, words_of(F.col("text"))))
        .select("doc_id", F.split("text", "\n", -1).alias("lines"))
        .select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.array_join(F.slice("lines", i, RUN), "\n"))).alias("line", "block"))
        .select("doc_id", "line", F.array_intersect(listed, words_of(F.col("block"))).alias("tokens"))
        .where(F.arrays_overlap(rare, "tokens"))
    )
    probes = blocks.select("doc_id", "line", "tokens", F.posexplode("tokens").alias("b_pos", "token"))
    size = F.size("tokens")
    left = F.least(F.col("t_size") - F.col("t_pos"), size - F.col("b_pos"))
    overlap = F.size(F.array_intersect("tokens", "t_tokens"))
    return (
        probes.join(F.broadcast(indexed), "token")
        .where((size >= F.col("need")) & (left >= F.col("need")))
        .select("doc_id", "line", "label", "need", "t_size", overlap.alias("overlap"))
        .where(F.col("overlap") >= F.col("need"))
        .select("doc_id", "line", "label", "overlap", (F.col("overlap") / F.col("t_size")).alias("containment"))
    )


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    docs = common.doc_texts(docs)
    found = template_matches(docs, templates, threshold).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = base_scan(docs, phrases).alias("b")
    joined = base.join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    none = F.expr("array()").cast("array<string>")
    return joined.select(
        F.col("b.doc_id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", none)))), ",").alias("labels"),
        F.round(F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))), 6).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    sets = template_tokens(TEMPLATES)
    values = ", ".join(f"('{k}', {v!r}, {needed(len(v), THRESHOLD)})" for k, v in sets.items())
    places = {k: f"list_filter(range(len(w)), lambda i: {' AND '.join(f"coalesce(w[i + {n}], '') = '{p}'" for n, p in enumerate(v.split(), 1))})" for k, v in PHRASES.items()}
    return rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
t(label, tokens, need) AS (VALUES {values}),
p AS (SELECT doc_id, len(w) AS n_words, {', '.join(f'{v} AS {k}' for k, v in places.items())} FROM d),
b AS (SELECT doc_id, n_words, list_concat(list_concat(mit, apache), gpl) AS pl,
  list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS base FROM p),
l AS (SELECT doc_id, list_distinct(regexp_extract_all(translate(block, '{UPPER}', '{LOWER}'), '{WORD}')) AS w FROM (SELECT doc_id, unnest(list_transform(range(1, len(t) + 1), lambda i: array_to_string(list_slice(t, i, i + {RUN - 1}), chr(10)))) AS block FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(w, tokens)) AS o, len(tokens) AS s FROM l, t WHERE len(list_intersect(w, tokens)) >= need),
f AS (SELECT doc_id, list(DISTINCT label) AS more, max(o / s) AS best FROM m GROUP BY doc_id)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(pl) AS BIGINT) AS n_base, CAST(list_min(pl) AS BIGINT) AS first_word, CAST(list_max(pl) AS BIGINT) AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  round(CASE WHEN len(pl) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END, 6) AS score
FROM b LEFT JOIN f ON b.doc_id IS NOT DISTINCT FROM f.doc_id
"""

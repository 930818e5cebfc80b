"""Conflicting values of a relation, and candidates for merging entities."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import jaccard, norm_name, predicate_tokens, words_of
from .graph import contained

SIMILAR, MERGE_COSINE, MERGE_TOP = 0.8, 0.6, 5


def predecessors(new: DataFrame, events: DataFrame) -> DataFrame:
    """(new_id, old_id): earlier factual events of the same first subject with the
    same predicate or alike masked texts.  Both sides carry id, subject,
    predicate, tokens, ins_seq.  Equal predicates are an equi-join; of others, only
    texts that share one of their first tokens in order are compared, as two sets at
    the threshold must (prefix filter)."""
    old = factual(events).select("subject", *[F.col(c).alias(f"old_{c}") for c in ("id", "predicate", "tokens", "ins_seq")])
    fresh, earlier = factual(new), F.col("old_ins_seq") < F.col("ins_seq")
    same = fresh.join(old, (fresh["subject"] == old["subject"]) & (F.col("predicate") == F.col("old_predicate"))).where(earlier)

    def keyed(df: DataFrame, tokens: str) -> DataFrame:
        n = F.size(tokens)
        first = F.slice(F.array_sort(tokens), F.lit(1), n - F.ceil(n * SIMILAR - 1e-9).cast("int") + 1)
        return df.where(n > 0).withColumn("token", F.explode(first))

    near = keyed(fresh, "tokens").join(keyed(old, "old_tokens"), ["subject", "token"]).where(earlier & (F.col("predicate") != F.col("old_predicate")) & (jaccard(F.col("tokens"), F.col("old_tokens")) >= SIMILAR))
    picked = [F.col("id").alias("new_id"), F.col("old_id")]
    return same.select(*picked).union(near.select(*picked).distinct())


def factual(events: DataFrame) -> DataFrame:
    return events.where("NOT coalesce(speech_act, false)")


def predecessor_counts(events: DataFrame) -> DataFrame:
    """(new_id, n, first, last) over the predecessors of the same subject and predicate,
    of every event of a whole graph: one window, no pairs."""
    before = Window.partitionBy("subject", "predicate").orderBy("ins_seq").rangeBetween(Window.unboundedPreceding, -1)
    counted = factual(events).select(F.col("id").alias("new_id"), F.count("*").over(before).alias("n"), F.min("id").over(before).alias("first"), F.max("id").over(before).alias("last"))
    return counted.where("n > 0")


def widened(new: DataFrame, events: DataFrame) -> DataFrame:
    """(new_id, old_id): the same with predicates that share a content token, which
    is a key of the join."""
    old = factual(events).select("subject", F.col("id").alias("old_id"), F.col("ins_seq").alias("old_ins_seq"), F.explode(predicate_tokens(F.col("predicate"))).alias("token"))
    asked = new.select("subject", "id", "ins_seq", F.explode(predicate_tokens(F.col("predicate"))).alias("token"))
    return asked.join(old, ["subject", "token"]).where("old_ins_seq < ins_seq").select(F.col("id").alias("new_id"), "old_id").distinct()


def object_values(events: DataFrame, entities: DataFrame) -> DataFrame:
    """events with object_value: the first object's canonical name, trimmed, in lower
    case; null without an object."""
    named = entities.select(F.col("id").alias("_o"), F.lower(F.trim("canonical_name")).alias("object_value"))
    first = events.withColumn("_o", F.try_element_at("object_ids", F.lit(1)))
    return first.join(named, "_o", "left").drop("_o")


def contested(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """new_id of events that, with their predecessors, hold exactly two values, one
    of them another than the new one's.  Events: id, object_value, normalized_text."""
    value = events.select("id", F.coalesce("object_value", "normalized_text").alias("v"), "object_value")
    old = pairs.join(value.select(F.col("id").alias("old_id"), F.col("v").alias("ov"), F.col("object_value").alias("oo")), "old_id")
    both = old.join(value.select(F.col("id").alias("new_id"), F.col("v").alias("nv"), F.col("object_value").alias("no")), "new_id")
    held = both.groupBy("new_id").agg(F.size(F.array_distinct(F.concat(F.collect_set("ov"), F.array(F.first("nv"))))).alias("values"), F.bool_or(~F.col("oo").eqNullSafe(F.col("no"))).alias("differs"))
    return held.where("values = 2 AND differs").select("new_id")


def remention(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """New events whose value a predecessor already holds: not adjudicated; they
    inherit the first mark found among such predecessors."""
    value = events.select("id", "object_value", "superseded_by", "ins_seq")
    old = pairs.join(value.select(F.col("id").alias("old_id"), F.col("object_value").alias("ov"), "superseded_by", "ins_seq"), "old_id")
    same = old.join(value.select(F.col("id").alias("new_id"), F.col("object_value").alias("nv")), "new_id").where("ov = nv")
    return same.groupBy("new_id").agg(F.min_by("superseded_by", F.when(F.col("superseded_by").isNotNull(), F.col("ins_seq"))).alias("inherited"))


def parse_supersede(reply: str) -> dict[int, str]:
    """Lines `N: single|multi`."""
    return {int(m[1]): m[2].lower() for m in re.finditer(r"(?im)^\s*(\d+)\s*[:：]\s*(single|multi)", reply)}


def parse_merge(reply: str) -> dict[int, tuple[int, bool]]:
    """Lines `N: M: sure|unsure`; a bare pair is unsure."""
    return {int(m[1]): (int(m[2]), (m[3] or "").lower() == "sure") for m in re.finditer(r"(?im)^\s*(\d+)\s*[:：]\s*(\d+)(?:\s*[:：]\s*(sure|unsure))?", reply)}


#: Contested groups, and mentions, that one call of an adjudicator judges at most.
A_CALL = 40


def shown_values(groups: DataFrame) -> DataFrame:
    """groups (new_id, ..., values): with shown, the distinct values in the order first seen."""
    return groups.withColumn("shown", F.array_distinct("values"))


def contested_groups(new: DataFrame, events: DataFrame) -> DataFrame:
    """(new_id, new_text, old: id and text by id, shown): what is to be adjudicated.
    Events contested by the exact rule, and those that only the widened one contests;
    a value that a predecessor already holds is no question."""
    pairs = predecessors(new, events)
    exact = contested(pairs, events)
    wide = widened(new, events).union(pairs).distinct()
    more = contested(wide, events).join(exact, "new_id", "left_anti")
    chosen = pairs.join(exact, "new_id", "left_semi").union(wide.join(more, "new_id", "left_semi"))
    chosen = chosen.join(remention(pairs, events).select("new_id"), "new_id", "left_anti")
    said = F.coalesce("object_value", "normalized_text")
    old = events.select(F.col("id").alias("old_id"), F.col("normalized_text").alias("old_text"), said.alias("old_value"), F.col("ins_seq").alias("old_seq"))
    asked = chosen.join(old, "old_id").join(events.select(F.col("id").alias("new_id"), F.col("normalized_text").alias("new_text"), said.alias("new_value")), "new_id")
    seen = F.transform(F.array_sort(F.collect_list(F.struct("old_seq", "old_value"))), lambda s: s["old_value"])
    held = asked.groupBy("new_id").agg(F.first("new_text").alias("new_text"), F.sort_array(F.collect_list(F.struct("old_id", "old_text"))).alias("old"), F.concat(seen, F.array(F.first("new_value"))).alias("values"))
    return shown_values(held).drop("values")


def detect(new: DataFrame, events: DataFrame, adjudicate: Callable[[list[tuple[str, str, list[str]]]], str]) -> DataFrame:
    """Marks (old_id, new_id, seq).  Contested groups are put to the adjudicator on the
    executors, A_CALL a call; a call that fails marks nothing."""

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            groups = list(frame[["new_id", "new_text", "old"]].itertuples(index=False, name=None))
            marks = []
            for i in range(0, len(groups), A_CALL):
                part = groups[i : i + A_CALL]
                try:
                    verdicts = parse_supersede(adjudicate([(n, t, [o["old_text"] for o in old]) for n, t, old in part]))
                except Exception:  # history stays as it is
                    verdicts = {}
                marks += [(o["old_id"], n, at) for at, (n, _, old) in enumerate(part, 1) if verdicts.get(at) == "single" for o in old]
            yield pd.DataFrame(marks, columns=["old_id", "new_id", "at"])

    kind = dict(events.dtypes)["id"]
    marks = contested_groups(new, events).mapInPandas(judged, f"old_id {kind}, new_id {kind}, at long").drop("at")
    return marks.join(events.select(F.col("id").alias("new_id"), F.col("ins_seq").alias("seq")), "new_id").select("old_id", "new_id", "seq")


def merge_candidates(mentions: DataFrame, entities: DataFrame, with_vectors: bool = False) -> DataFrame:
    """(mention, entity_id, score, rank), at most MERGE_TOP a mention: 1 where a name
    contains the other, 0.9 for a shared word of three letters or more, else the
    cosine from MERGE_COSINE.  Shared words are an equi-join; containment, either way,
    is a search for many names in one pass (contained); vectors, a batch's mentions
    with all entities, meet in blocks of bounded size."""
    m = mentions.select(F.col("name").alias("mention"), norm_name(F.col("name")).alias("mn"), *([F.col("embedding").alias("mv")] if with_vectors else []))
    e = entities.select(F.col("id").alias("entity_id"), norm_name(F.col("canonical_name")).alias("en"), *([F.col("embedding").alias("ev")] if with_vectors else []))

    def long_words(c):
        return F.array_distinct(F.filter(words_of(c), lambda w: F.length(w) >= 3))

    inside = contained(m.select("mention", "mn"), "mn", e.select(F.col("entity_id").alias("key"), F.col("en").alias("name"))).select("mention", F.col("key").alias("entity_id"), F.lit(1.0).alias("score"))
    around = contained(e.select("entity_id", "en"), "en", m.select(F.col("mention").alias("key"), F.col("mn").alias("name"))).select(F.col("key").alias("mention"), "entity_id", F.lit(1.0).alias("score"))
    shared = m.select("mention", F.explode(long_words(F.col("mn"))).alias("w")).join(e.select("entity_id", F.explode(long_words(F.col("en"))).alias("w")), "w").select("mention", "entity_id", F.lit(0.9).alias("score"))
    found = inside.union(around).union(shared)
    if with_vectors:
        close = vectors.alike(m.select(F.col("mention").alias("id"), F.col("mv").alias("v")), e.select(F.col("entity_id").alias("id"), F.col("ev").alias("v")), MERGE_COSINE)
        found = found.union(close.select(F.col("query_id").alias("mention"), F.col("near_id").alias("entity_id"), "score"))
    best = found.groupBy("mention", "entity_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "entity_id"))).where(F.col("rank") <= MERGE_TOP)


def find_merges(mentions: DataFrame, entities: DataFrame, adjudicate: Callable[[list[tuple]], str], events: DataFrame | None = None, with_vectors: bool = False) -> DataFrame:
    """(name, canonical): mentions (name, type, sample_fact) that the adjudicator is sure
    are an existing entity (id, canonical_name, type, aliases).  It is asked on the
    executors, A_CALL mentions a call, with at most MERGE_TOP numbered candidates a
    mention and, given events, the first fact of each; a failed call, an unsure or
    an unreadable line merges nothing."""
    found = merge_candidates(mentions.select("name", *(["embedding"] if with_vectors else [])), entities, with_vectors)
    known = entities.select(F.col("id").alias("entity_id"), "canonical_name", "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    if events is not None:
        first = events.select(F.explode(F.concat("subject_ids", "object_ids")).alias("entity_id"), "ins_seq", "normalized_text").groupBy("entity_id").agg(F.substring(F.min_by("normalized_text", "ins_seq"), 1, 80).alias("known_fact"))
        known = known.join(first, "entity_id", "left")
    else:
        known = known.withColumn("known_fact", F.lit(""))
    row = F.struct("rank", "canonical_name", "type", "aliases", F.coalesce("known_fact", F.lit("")).alias("known_fact"))
    listed = found.join(known, "entity_id").groupBy(F.col("mention").alias("name")).agg(F.array_sort(F.collect_list(row)).alias("candidates"))
    asked = mentions.select("name", F.col("type").alias("kind"), F.substring("sample_fact", 1, 120).alias("sample_fact")).join(listed, "name")

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, out = list(frame[["name", "kind", "sample_fact", "candidates"]].itertuples(index=False, name=None)), []
            for i in range(0, len(rows), A_CALL):
                part = rows[i : i + A_CALL]
                lines = [(n, k, s, [(c["canonical_name"], c["type"], list(c["aliases"]), c["known_fact"]) for c in held]) for n, k, s, held in part]
                try:
                    verdicts = parse_merge(adjudicate(lines))
                except Exception:  # no merge
                    verdicts = {}
                for at, (pick, sure) in verdicts.items():
                    if sure and 1 <= at <= len(part) and 1 <= pick <= len(lines[at - 1][3]):
                        out.append((part[at - 1][0], lines[at - 1][3][pick - 1][0]))
            yield pd.DataFrame(out, columns=["name", "canonical"])

    return asked.mapInPandas(judged, "name string, canonical string")

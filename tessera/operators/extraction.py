"""From a turn's text to rows of the graph."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_field, query_words
from ..functions.timeexpr import event_time, extract_time
from ..schema import ENTITY_TYPES
from .conflict import find_merges
from .graph import accrete, contained, find_by_name, new_only, resolve_or_create, retro_link

MIN_FACT, SEGMENT, KNOWN_NAMES, RECENT_PREDICATES = 12, 8000, 4000, 60


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Whole lines up to size characters each; a longer line is cut hard."""
    out: list[str] = []
    held: list[str] = []
    used = 0
    for line in text.split("\n"):
        for piece in [line[i : i + size] for i in range(0, len(line), size)] or [""]:
            extra = len(piece) + (1 if held else 0)
            if held and used + extra > size:
                out.append("\n".join(held))
                held, used, extra = [], 0, len(piece)
            held.append(piece)
            used += extra
    return [*out, "\n".join(held)] if held else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def segment_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: segments(t) if t else [])


def parse_rows(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Pipe rows of a model's reply, one row each, with row_no; other columns stay."""
    lines = replies.select("*", F.posexplode(F.split(text, "\n", -1)).alias("row_no", "_line")).withColumn("_line", F.trim("_line"))
    lines = lines.where("_line <> '' AND NOT startswith(_line, 'Output') AND NOT startswith(_line, 'Rows:')")
    lines = lines.withColumn("_line", F.regexp_replace("_line", "<([^>]+)>", "|$1")).where(F.contains("_line", F.lit("|")))
    parts = F.split("_line", r"\|", -1)
    parts = F.when(F.trim(parts[0]).rlike(r"(?i)^T\d+$"), F.slice(parts, 2, 1000)).otherwise(parts)
    lines = lines.withColumn("_p", parts)

    def field(i: int) -> Column:
        return F.coalesce(F.get("_p", F.lit(i)), F.lit(""))

    kind = F.upper(F.trim(field(0)))
    aliases = F.filter(F.transform(F.split(field(2), ","), lambda a: F.trim(a)), lambda a: (a != "") & (a != "_"))
    out = lines.withColumns(
        {
            "entity_type": kind,
            "canonical": F.trim(field(1)),
            "aliases": aliases,
            "predicate": clean_field(field(3)),
            "object": clean_field(field(4)),
            "time_expr": clean_field(field(5)),
            "fact": clean_field(field(6)),
            "details": clean_field(field(7)),
            "speech_act": F.lower(clean_field(field(8))) == "speech",
        }
    )
    return out.where((F.col("canonical") != "") & F.col("entity_type").isin(*ENTITY_TYPES)).drop("_line", "_p", text)


def parsed_entities(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each (canonical, type) within keys."""
    first = Window.partitionBy(*keys, F.lower("canonical"), "entity_type").orderBy("row_no")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def speakers(c: Column) -> Column:
    """Distinct names that open a line as `Name: `."""
    heads = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_extract(F.trim(x), r"^([A-Z][a-zA-Z\s]+):\s", 1))
    return F.array_distinct(F.filter(heads, lambda x: x != ""))


def coerce_speakers(rows: DataFrame, names: str = "speakers") -> DataFrame:
    """A row about a speaker of its turn is about a person."""
    low = F.transform(names, lambda n: F.lower(n))
    return rows.withColumn("entity_type", F.when(F.array_contains(low, F.lower("canonical")), "PERSON").otherwise(F.col("entity_type")))


def quality_gate(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("fact") >= MIN_FACT)


def known_names(entities: DataFrame, texts: DataFrame | None = None, key: str = "key", text: str = "text") -> DataFrame:
    """Names and aliases of entities (id, canonical_name, type, aliases, ins_seq) as
    `name (TYPE)`, in code-point order, comma-joined and cut at a comma within the cap;
    of a name of several entities the latest's type counts.  One row (names), or, with
    texts (key, text), one a text with those that it contains, whatever the case."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in entities.columns else F.array().cast("array<string>")
    every = entities.select("type", "ins_seq", F.posexplode(F.concat(F.array("canonical_name"), aliases)).alias("pos", "name"))
    shown = every.groupBy("name").agg(F.max_by("type", F.struct("ins_seq", "pos")).alias("type")).select("name", F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("shown"))

    def cut(names: Column) -> Column:
        return F.when(F.length(names) > KNOWN_NAMES, F.regexp_replace(F.substring(names, 1, KNOWN_NAMES), "(?<=.),[^,]*$", "")).otherwise(names)

    if texts is None:  # more names than characters can't be shown
        first = shown.orderBy("shown").limit(KNOWN_NAMES).agg(F.array_join(F.array_sort(F.collect_list("shown")), ", ").alias("names"), F.count("*").alias("n"))
        return first.select(F.when(F.col("n") == 0, "(none yet)").otherwise(cut(F.col("names"))).alias("names"))
    asked = texts.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    held = contained(asked, "_t", shown.select(F.col("shown").alias("key"), "name"), keep=["_k"]).withColumnsRenamed({"key": "_shown", "_k": key})
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_shown"))
    listed = held.select(key, "_shown").distinct().withColumn("_n", nth).where(F.col("_n") <= KNOWN_NAMES).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("_shown")), ", ").alias("names"))
    none = entities.limit(1).agg((F.count("*") == 0).alias("_none"))
    out = texts.select(key).join(listed, key, "left").crossJoin(F.broadcast(none))
    return out.select(key, F.when(F.col("_none"), "(none yet)").otherwise(F.coalesce(cut(F.col("names")), F.lit("(none relevant)"))).alias("names"))


def recent_predicates(mentioned: DataFrame) -> DataFrame:
    """(predicate, seq) -> one row: the first distinct predicates met, comma-joined."""
    first = mentioned.groupBy("predicate").agg(F.min("seq").alias("seq")).orderBy("seq").limit(RECENT_PREDICATES)
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "predicate"))), lambda s: s["predicate"]), ", ").alias("predicates"))


def call_model(jobs: DataFrame, prompt: str, model: Callable[[str], str]) -> DataFrame:
    """jobs with a column reply; the model is called on the executors, a batch at a
    time, and a call that fails leaves a null reply to be tried again."""
    schema = T.StructType([*jobs.schema.fields, T.StructField("reply", T.StringType())])

    def called(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = []
            for p in frame[prompt]:
                try:
                    replies.append(model(p))
                except Exception:  # the job's log records the failure
                    replies.append(None)
            yield frame.assign(reply=replies)

    return jobs.mapInPandas(called, schema)


def extract(turns: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """turns (session_id, turn, turn_text, mention_time) -> gated rows with speakers coerced."""
    from ..functions.text import cap_text

    cut = turns.withColumns({"speakers": speakers(F.col("turn_text")), "_parts": segment_text(cap_text(F.col("turn_text")))})
    parts = cut.select("session_id", "turn", "mention_time", "speakers", F.posexplode("_parts").alias("part", "prompt"))
    rows = parse_rows(call_model(parts, "prompt", model).drop("prompt"))
    return quality_gate(coerce_speakers(rows)).drop("speakers")


def merge_rows(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """rows whose canonical name or object is merged (name, canonical): the target's name
    takes its place, and a merged canonical name becomes an alias."""
    one = merges.select(F.col("name").alias("canonical"), F.col("canonical").alias("_to"))
    two = merges.select(F.col("name").alias("object"), F.col("canonical").alias("_object"))
    out = rows.join(one, "canonical", "left").join(two, "object", "left")
    grown = F.when(F.col("_to").isNotNull(), F.array_distinct(F.concat("aliases", F.array("canonical")))).otherwise(F.col("aliases"))
    return out.withColumns({"aliases": grown, "canonical": F.coalesce("_to", "canonical"), "object": F.coalesce("_object", "object")}).drop("_to", "_object")


@dataclass
class Ingested:
    """What a batch of turns adds: new entities, those that gained aliases, events
    (ready to be appended; their ids are hashes, so a replay repeats them), links of
    facts remembered before their entities were known, and counters a turn."""

    fresh: DataFrame
    grown: DataFrame
    events: DataFrame
    links: DataFrame
    counters: DataFrame


def ingest(turns: DataFrame, model: Callable[[str], str], entities: DataFrame, events: DataFrame, adjudicate: Callable[[list[tuple]], str] | None = None, scratch: str | None = None) -> Ingested:
    """turns (session_id, turn, turn_text, mention_time) into the graph: extracted rows,
    merged where the adjudicator is sure, without those already recorded, their times
    resolved, their names resolved or created.  What models said is kept, as all parts
    of the result read it: in `scratch`, a folder that executors share, else cached."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        if scratch is None:
            return df.persist()
        path = f"{scratch}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    rows = kept(extract(turns, model).withColumn("seq", F.struct("session_id", "turn", "part", "row_no")), "rows")
    if adjudicate is not None:
        subjects = rows.select(F.col("canonical").alias("name"), F.col("entity_type").alias("type"), F.col("fact").alias("sample_fact"), "seq")
        objects = rows.where("object <> ''").select(F.col("object").alias("name"), F.lit("CONCEPT").alias("type"), F.col("fact").alias("sample_fact"), "seq")
        every = subjects.unionByName(objects).groupBy("name").agg(F.min_by("type", "seq").alias("type"), F.min_by("sample_fact", "seq").alias("sample_fact"))
        unknown = every.join(find_by_name(every.select("name"), "name", entities).where("id IS NOT NULL").select("name"), "name", "left_anti")
        rows = merge_rows(rows, kept(find_merges(unknown, entities, adjudicate, events), "merges"))
    said = F.coalesce(F.nullif("time_expr", F.lit("")), extract_time(F.col("fact")), F.lit(""))
    when = event_time(F.col("time_expr"), F.col("mention_time"), F.col("fact"))
    facts = rows.withColumns({"source_session": F.col("session_id").cast("string"), "source_turn": F.col("turn").cast("int"), "normalized_text": F.col("fact"), "_when": when})
    facts = new_only(facts.withColumn("time_expr", said), events)
    once = Window.partitionBy("source_session", "source_turn", "predicate", F.lower(F.trim("normalized_text")), F.lower(F.trim("time_expr"))).orderBy("seq")
    facts = kept(facts.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n"), "facts")
    subjects = facts.select(F.col("canonical").alias("name"), F.col("entity_type").alias("type"), "aliases", "seq", F.lit(0).alias("side"))
    objects = facts.where("object <> ''").select(F.col("object").alias("name"), F.lit("CONCEPT").alias("type"), F.array().cast("array<string>").alias("aliases"), "seq", F.lit(1).alias("side"))
    mentions = subjects.unionByName(objects).withColumn("seq", F.struct("seq", "side"))
    resolved, fresh = resolve_or_create(mentions, entities)
    resolved, fresh = kept(resolved, "resolved"), kept(fresh, "fresh")
    made = fresh.withColumn("aliases", F.array().cast("array<string>"))
    first = resolved.where("created").groupBy("id").agg(F.min("seq").alias("_first"))
    placed = resolved.join(first, "id", "left")
    of = lambda side, c: placed.where(f"seq.side = {side}").select(F.col("seq.seq").alias("seq"), F.col("id").alias(c), (F.col("created") & (F.col("seq") == F.col("_first"))).alias(f"{c}_new"))
    joined = facts.join(of(0, "_subject"), "seq").join(of(1, "_object"), "seq", "left")
    none = F.array().cast("array<string>")
    written = joined.select(
        F.sha2(F.concat_ws("|", "source_session", F.col("source_turn").cast("string"), "predicate", "normalized_text", "time_expr"), 256).alias("id"),
        F.array("_subject").alias("subject_ids"),
        F.when(F.col("_object").isNotNull(), F.array("_object")).otherwise(none).alias("object_ids"),
        *["predicate", "normalized_text", "details", "time_expr"],
        F.col("_when.time").alias("event_time"),
        F.col("_when.precision").alias("event_time_precision"),
        *["mention_time", "source_session", "source_turn", "speech_act"],
        "seq",
    )
    counters = joined.groupBy("source_session", "source_turn").agg(F.count_if("_subject_new").alias("entities_created"), F.count_if(~F.col("_subject_new")).alias("entities_reused"), F.count("*").alias("events_added"))
    known = entities.select("id", "canonical_name", "type", "aliases", "ins_seq")
    numbered = made.select("id", "canonical_name", "type", "aliases", (F.lit(1 << 62) + F.hash("id")).alias("ins_seq"))
    return Ingested(made, accrete(resolved, known.unionByName(numbered)), written, retro_link(events, known.unionByName(numbered)), counters)


def expansion_words(reply: str) -> list[str]:
    """Distinct sorted words of a reply, one expansion a line, with or without a bullet."""
    words: set[str] = set()
    for line in reply.split("\n"):
        line = line.strip()
        words.update(query_words((line[1:] if line[:1] in ("-", "•") else line).strip()))
    return sorted(words)


class QueryModel:
    """A model asked about queries, with a cache by the normalized query that holds good
    answers only: empty expansions, and quotes that are empty or longer than the query,
    are failures and asked again."""

    def __init__(self, call: Callable[[str], str], cache: dict | None = None):
        self.call, self.cache = call, {} if cache is None else cache

    def _key(self, kind: str, query: str) -> tuple[str, str]:
        return kind, re.sub(r"\s+", " ", query.lower())

    def expand(self, query: str) -> list[str]:
        key = self._key("expand", query)
        if key not in self.cache:
            try:
                words = expansion_words(self.call(query))
            except Exception:  # no expansion then
                words = []
            if not words:
                return []
            self.cache[key] = words
        return self.cache[key]

    def distill(self, query: str) -> str | None:
        key = self._key("distill", query)
        if key not in self.cache:
            try:
                quote = self.call(query).strip()
            except Exception:  # the caller keeps the query
                return None
            if not quote or len(quote) > len(query):
                return None
            self.cache[key] = quote
        return self.cache[key]

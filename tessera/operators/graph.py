"""The memory graph: journal replay, compaction, deletes, links, degrees."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_name
from ..schema import JOURNAL_OPS, PAYLOAD

#: Names that are sent to the workers at a time.
NAMES = 200_000
#: Bytes of rows that a worker makes of a text's copies at a time.
PIECE = 8 << 20


def valid_records(journal: DataFrame) -> DataFrame:
    """Records with the right envelope and the fields their kind requires."""
    data = F.col("data")
    need = F.when(F.col("op") == "event.add", data["normalized_text"].isNotNull()).when(F.col("op") == "entity.upsert", data["canonical_name"].isNotNull()).otherwise(True)
    return journal.where((F.col("v") == 1) & F.col("op").isin(*JOURNAL_OPS) & data["id"].isNotNull() & need)


def corrupt_count(journal: DataFrame) -> DataFrame:
    """corrupt: lines that aren't a record; valid: the others."""
    good = valid_records(journal).agg(F.count("*").alias("valid"))
    return journal.agg(F.count("*").alias("n")).crossJoin(F.broadcast(good)).select((F.col("n") - F.col("valid")).alias("corrupt"), "valid")


def replay(records: DataFrame, kind: str, id_col: Column, seq: str = "seq") -> DataFrame:
    """Live rows of one kind: the last record of each id, unless it deletes.
    ins_seq is the first seq after the last delete, so a row written again keeps
    its place and one added anew after a delete moves to the end.  One shuffle."""
    mine = records.where(F.split("op", "[.]")[0] == kind).withColumn("id", id_col)
    gone = F.col("op").endswith(".delete")
    whole = Window.partitionBy("id")
    marked = mine.withColumns({"_last": F.max(seq).over(whole), "_dead": F.max(F.when(gone, F.col(seq))).over(whole)})
    first = F.min(F.when(F.col("_dead").isNull() | (F.col(seq) > F.col("_dead")), F.col(seq))).over(whole)
    return marked.withColumn("ins_seq", first).where((F.col(seq) == F.col("_last")) & ~gone).drop("_last", "_dead")


def bridge(events: DataFrame) -> DataFrame:
    """(event_id, entity_id, role, pos, ins_seq): subjects first, then objects."""
    parts = [events.select(F.col("id").alias("event_id"), F.posexplode(f"{role}_ids").alias("pos", "entity_id"), F.lit(role).alias("role"), "ins_seq") for role in ("subject", "object")]
    return parts[0].unionByName(parts[1])


def by_ids(rows: DataFrame, ids: list) -> DataFrame:
    """Rows of the given ids."""
    return rows.where(F.col("id").isin(list(ids)))


def shape(events: DataFrame) -> DataFrame:
    """One row of events (id, subject_ids, object_ids, mention_time): entities, events, and
    the span of mention times."""
    held = events.select(F.explode(F.concat("subject_ids", "object_ids")).alias("e")).agg(F.count_distinct("e").alias("entities"))
    return held.crossJoin(F.broadcast(events.agg(F.count("*").alias("events"), F.min("mention_time").alias("first"), F.max("mention_time").alias("last"))))


def events_of(events: DataFrame, entity_id: str) -> DataFrame:
    """Distinct events of an entity, in insertion order."""
    held = F.array_contains("subject_ids", entity_id) | F.array_contains("object_ids", entity_id)
    return events.where(held).orderBy("ins_seq")


def names(entities: DataFrame) -> DataFrame:
    """(norm_name, id, type): canonical names and aliases; the last writer of a name owns it."""
    every = entities.select("id", "type", "ins_seq", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    named = every.withColumn("norm_name", norm_name(F.col("name"))).where("norm_name <> ''")
    return named.groupBy("norm_name").agg(F.max_by(F.struct("id", "type"), "ins_seq").alias("o")).select("norm_name", "o.id", "o.type")


def find_by_name(asked: DataFrame, name: str, entities: DataFrame, kind: str | None = None) -> DataFrame:
    """asked with id and type of the entity that owns the name or alias, if any; with
    kind only if it is of that type."""
    owned = names(entities)
    owned = owned.where(F.col("type") == kind) if kind else owned
    return asked.withColumn("norm_name", norm_name(F.col(name))).join(owned, "norm_name", "left").drop("norm_name")


def degrees(events: DataFrame) -> DataFrame:
    """(entity_id, degree): occurrences as subject or object, with multiplicity."""
    return events.select(F.explode(F.concat("subject_ids", "object_ids")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))


def links(events: DataFrame) -> DataFrame:
    """Every subject with every object of an event; a self-loop where there's no object."""
    source = events.select("id", "predicate", "object_ids", F.explode("subject_ids").alias("source"))
    return source.select("id", "predicate", "source", F.explode_outer("object_ids").alias("t")).select("id", "predicate", "source", F.coalesce("t", "source").alias("target"))


def capped(nodes: DataFrame, edges: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The cap nodes of highest degree, and the edges between them."""
    top = nodes.orderBy(F.desc("degree"), "entity_id").limit(cap)
    ends = [F.broadcast(top.select(F.col("entity_id").alias(c))) for c in ("source", "target")]
    return top, edges.join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi")


def delete_entity(entities: DataFrame, events: DataFrame, entity_id: str) -> tuple[DataFrame, DataFrame]:
    """The entity goes and its id leaves every event's lists."""
    strip = {c: F.array_remove(c, entity_id) for c in ("subject_ids", "object_ids")}
    return entities.where(F.col("id") != entity_id), events.withColumns(strip)


def mark_superseded(events: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (old_id, new_id, seq): set where both events exist; the mark of an event
    with the largest seq wins."""
    known = marks.join(events.select(F.col("id").alias("new_id")), "new_id", "left_semi").groupBy("old_id").agg(F.max_by("new_id", F.struct("seq", "new_id")).alias("new_id"))
    return events.join(known, events["id"] == known["old_id"], "left").withColumn("superseded_by", F.coalesce("new_id", "superseded_by")).drop("old_id", "new_id")


IDEMPOTENCY = ("source_session", "source_turn")


def new_only(batch: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of batch whose (session, turn, predicate, text, time) isn't recorded yet."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_t": norm_name(F.col("normalized_text")), "_x": F.lower(F.trim("time_expr"))})

    on = [*IDEMPOTENCY, "predicate", "_t", "_x"]
    return keyed(batch).join(keyed(events).select(*on).distinct(), on, "left_anti").drop("_t", "_x")


def resolve_or_create(mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mentions (name, type, seq) -> (resolved with id and created, new entities).
    Mentions of one batch that normalize alike become one entity, of the first's
    name and type.  Ids are hashes of the normalized name, so a replay repeats them."""
    keyed = mentions.withColumn("norm_name", norm_name(F.col("name"))).where("norm_name <> ''")
    known = keyed.join(names(entities).select("norm_name", F.col("id").alias("known_id")), "norm_name", "left")
    resolved = known.withColumns({"id": F.coalesce("known_id", F.sha2("norm_name", 256)), "created": F.col("known_id").isNull()}).drop("known_id")
    fresh = resolved.where("created").groupBy("id").agg(F.min_by("name", "seq").alias("canonical_name"), F.min_by("type", "seq").alias("type"), F.min("seq").alias("ins_seq"))
    return resolved, fresh


def accrete(resolved: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities that gain aliases, with those added in the order met: names and
    aliases of resolved mentions (id, name, seq, and aliases if there are) whose
    normalized form is neither the canonical name's nor an alias's yet."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")
    offered = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in resolved.columns else F.array("name")
    every = resolved.select("id", "seq", F.posexplode(offered).alias("pos", "alias")).withColumns({"alias": clean(F.col("alias")), "norm": norm_name(F.col("alias"))})
    at = F.struct("seq", "pos")
    first = every.where("norm <> ''").groupBy("id", "norm").agg(F.min_by("alias", at).alias("alias"), F.min(at).alias("at"))
    held = entities.select("id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("id", norm_name(F.col("n")).alias("norm"))
    more = first.join(held, ["id", "norm"], "left_anti").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("_more"))
    return entities.join(more, "id").withColumn("aliases", F.concat(F.coalesce("aliases", F.array().cast("array<string>")), "_more")).drop("_more")


def records(op: str, rows: DataFrame) -> DataFrame:
    """Journal records (v, op, data) of rows, whose missing fields are null."""
    fields = [x.split(" ", 1) for x in PAYLOAD.split(", ")]
    data = F.struct(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t.lower()).alias(n) for n, t in fields])
    return rows.select(F.lit(1).alias("v"), F.lit(op).alias("op"), data.alias("data"))


_AUTOMATA: dict[str, object] = {}


def _automaton(key: str, block: tuple):
    """Built once a worker and block; a worker keeps the last."""
    import ahocorasick

    if key in _AUTOMATA:
        return _AUTOMATA[key]
    _AUTOMATA.clear()
    found = ahocorasick.Automaton()
    by: dict = {}
    for name, owner in block:
        by.setdefault(name, []).append(owner)
    for name, owners in by.items():
        found.add_word(name, owners)
    found.make_automaton()
    _AUTOMATA[key] = found
    return found


def contained(texts: DataFrame, text: str, named: DataFrame, block: int = NAMES, keep: Sequence[str] | None = None) -> DataFrame:
    """texts (its columns keep; all, if None) with each key of named (key, name) whose
    name, in lower case and not empty, the text contains, once a pair.  Names go to the
    workers in blocks, whatever their number, and a text is searched for a block's names
    in one pass; texts aren't moved.  What is kept is copied to each of a text's keys, so
    leave a long text out of keep; copies go out in pieces of PIECE bytes."""
    kinds, columns = dict(texts.dtypes), texts.columns if keep is None else [*keep]
    key_kind = dict(named.dtypes)["key"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"key {key_kind}"])
    lowered = texts.select(*[F.col(f"`{c}`") for c in columns], F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))

    def searched(part: list) -> DataFrame:
        sent, name = texts.sparkSession.sparkContext.broadcast(tuple(part)), uuid.uuid4().hex

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, sent.value) if sent.value else None
            for b in batches if automaton else ():
                low, kept = b.column(b.num_columns - 1), b.select([*range(b.num_columns - 1)])
                at, keys, size = [], [], 0

                def piece(kept=kept) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([*kept.take(pa.array(at, pa.int64())).columns, pa.array(keys, kind_of(key_kind))], names=[*columns, "key"])

                for i in range(b.num_rows):
                    met = {k: None for _, owners in automaton.iter(low[i].as_py()) for k in owners}
                    width = kept.slice(i, 1).nbytes + 64 if met else 0
                    for k in met:
                        at.append(i)
                        keys.append(k)
                        size += width
                        if size >= PIECE:
                            yield piece()
                            at, keys, size = [], [], 0
                if at:
                    yield piece()

        return lowered.mapInArrow(found, schema)

    out, part = None, []
    for r in named.select(F.lower("name").alias("name"), "key").where("name <> ''").distinct().toLocalIterator():
        part.append((r["name"], r["key"]))
        if len(part) == block:
            out = searched(part) if out is None else out.union(searched(part))
            part = []
    if part or out is None:
        out = searched(part) if out is None else out.union(searched(part))
    return out


def kind_of(name: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]


def name_list(entities: DataFrame, least: int = 1) -> DataFrame:
    """(key, name) of canonical names and aliases of at least `least` characters; key: the entity."""
    every = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in entities.columns else F.array("canonical_name")
    return entities.select(F.col("id").alias("key"), F.explode(F.array_distinct(F.transform(every, lambda n: F.lower(F.trim(n))))).alias("name")).where(F.length("name") >= least)


def mentions_in(texts: DataFrame, text: str, entities: DataFrame, least: int = 1) -> DataFrame:
    """texts with entity_id of each entity one of whose names (of at least `least`
    characters) they contain."""
    return contained(texts, text, name_list(entities, least)).withColumnRenamed("key", "entity_id").distinct()


def orphans(events: DataFrame) -> DataFrame:
    """Remembered facts that no entity is linked to yet."""
    return events.where((F.col("predicate") == "remembered") & (F.size("subject_ids") == 0))


def retro_link(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, subject_ids, object_ids) of the orphans that hold names of entities by now:
    the first entity, by insertion, is the subject and the others are objects."""
    held = mentions_in(orphans(events).select("id", "normalized_text"), "normalized_text", entities, 2)
    placed = held.join(entities.select(F.col("id").alias("entity_id"), "ins_seq"), "entity_id")
    listed = placed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ins_seq", "entity_id"))), lambda s: s["entity_id"]).alias("e"))
    return listed.select("id", F.slice("e", 1, 1).alias("subject_ids"), F.expr("slice(e, 2, greatest(size(e) - 1, 0))").alias("object_ids"))


def text_filter(links: DataFrame, asked: str) -> DataFrame:
    """Links (predicate, source_name, target_name, fact) one of whose texts holds what is
    asked, whatever the case; all if nothing is."""
    low = F.lower(F.concat_ws("\n", "fact", "predicate", "source_name", "target_name"))
    return links.where(F.contains(low, F.lit(asked.strip().lower())))


def by_time_label(links: DataFrame) -> DataFrame:
    """Links, newest label first; labels are compared as texts."""
    return links.orderBy(F.desc_nulls_last("label"), "id")

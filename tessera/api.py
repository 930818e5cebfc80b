"""The engine: search, remember, graph, status, the context block; changes as journal records."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import vectors
from .functions.temporal import resolve_query
from .functions.text import is_list_question, key_descriptors, matched_stems, memory_line, norm_name, query_stems, query_words
from .operators import evaluation, graph, jobs, rerank, retrieval
from .schema import EVENT

Embed = Callable[[str], list[float] | None]


class Engine:
    """Over entities and events (tessera.schema).  Time is always a parameter."""

    def __init__(self, entities: DataFrame, events: DataFrame, embed: Embed | None = None, expand: Callable[[str], list[str]] | None = None):
        self.entities, self.events, self.embed, self.expand = entities, events, embed, expand

    def event_texts(self) -> DataFrame:
        """events with event_text: names, predicate, fact and details, in that order."""
        names = self.entities.select(F.col("id").alias("_e"), "canonical_name")
        ids = self.events.select("id", F.posexplode(F.concat("subject_ids", "object_ids")).alias("_pos", "_e")).join(names, "_e", "left")
        joined = ids.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("canonical_name", F.lit("")).alias("n")))), lambda s: s["n"]), " ").alias("_names"))
        return self.events.join(joined, "id", "left").withColumn("event_text", F.lower(F.concat_ws(" ", F.coalesce("_names", F.lit("")), "predicate", "normalized_text", "details"))).drop("_names")

    def scored(self, query: str, anchor: datetime, top_k: int) -> DataFrame:
        op, words = resolve_query(query, anchor), query_stems(query)
        events, bridge = self.event_texts(), graph.bridge(self.events)
        spark = events.sparkSession
        asked = spark.createDataFrame([(query,)], "q string")
        mentioned = graph.mentions_in(asked, "q", self.entities).select("entity_id")
        by_entity = bridge.join(F.broadcast(mentioned), "entity_id", "left_semi").select(F.col("event_id").alias("id")).distinct()
        top = retrieval.dense_slice(events, self.embed(query) if self.embed else None, words, 2 * top_k).select("id", "dense")
        topics = top.orderBy(F.desc("dense"), "id").limit(retrieval.HOP_HITS).select(F.col("id").alias("event_id"))
        hop = retrieval.one_hop(topics, bridge).select(F.col("event_id").alias("id"))
        ids = by_entity.union(top.select("id")).union(hop).distinct()
        pool = events.join(ids, "id", "left_semi").join(top, "id", "left").join(by_entity.withColumn("mentioned", F.lit(True)), "id", "left")
        every = events.withColumns({"dense": F.lit(0.0), "mentioned": F.lit(False)})
        pool = retrieval.temporal_pool(pool.withColumn("mentioned", F.coalesce("mentioned", F.lit(False))), every, op).withColumn("event_text", F.coalesce("event_text", F.lit("")))
        extra, described = self.expand(query) if self.expand else [], key_descriptors(query)
        pool = pool.withColumn("stems", matched_stems(F.col("event_text"), list(dict.fromkeys([*words, *extra, *described]))))
        keyed = retrieval.keyword_scores(pool, words, extra, described)
        base = retrieval.compose(keyed, op)
        boosted = retrieval.topic_boost(retrieval.locality(base), bridge, self.entities)
        return retrieval.dedup_state(boosted.withColumn("score", F.col("score") + F.col("turn_boost") + F.col("topic_boost")))

    def retrieve(self, query: str, anchor: datetime, top_k: int = 10) -> list[dict]:
        """The answer's rows, in order; at most the pool that a limit has cut."""
        listed = is_list_question(query)
        cut = self.scored(query, anchor, top_k).orderBy(*retrieval.ranked(self.events)).limit(top_k * (10 if listed else 1))
        rows = [r.asDict() for r in cut.collect()]
        if listed:
            return rerank.mmr(rows, top_k)
        return rerank.newest_first(rows, lambda r: set(query_words(r["normalized_text"])))

    def search(self, query: str, anchor: datetime, time_range: str = "") -> DataFrame:
        found = self.retrieve(f"{query} {time_range}".strip(), anchor)
        rows = [(r["normalized_text"], r["time_expr"] or "", r["details"] or "", None) for r in found]
        rows += [(e["normalized_text"], e["time_expr"] or "", e["details"] or "", via) for e, via in self.neighbors(found, 6, 2)]
        return self.events.sparkSession.createDataFrame(rows, "fact string, time string, details string, via string")

    def neighbors(self, hits: list[dict], most: int, depth: int) -> list[tuple[dict, str]]:
        """Events that share an entity with the first hits, with its name: one query a
        hop for the newest events of all its entities, whatever their number."""

        def of(entities: list[str]) -> dict[str, list[dict]]:
            near = graph.bridge(self.events.where("NOT coalesce(speech_act, false)")).where(F.col("entity_id").isin(entities)).select("entity_id", F.col("event_id").alias("id")).distinct()
            newest = Window.partitionBy("entity_id").orderBy(F.desc("mention_time"), "ins_seq")
            rows = near.join(self.events, "id").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= rerank.PER_HOP + most + len(hits))
            out: dict[str, list[dict]] = {}
            for r in rows.orderBy("entity_id", "_n").collect():
                out.setdefault(r["entity_id"], []).append(r.asDict())
            return out

        def names(entities: list[str]) -> dict[str, str]:
            return {r["id"]: r["canonical_name"] for r in self.entities.where(F.col("id").isin(entities)).select("id", "canonical_name").collect()}

        return rerank.neighbors(hits, of, names, most, depth)

    def remember(self, fact: str, now: datetime, time_expr: str = "") -> DataFrame:
        """The event row to append: linked to the entities whose names the fact holds."""
        spark = self.events.sparkSession
        asked = spark.createDataFrame([(fact,)], "q string")
        order = graph.mentions_in(asked, "q", self.entities, 2).join(self.entities.select(F.col("id").alias("entity_id"), "ins_seq"), "entity_id")
        ids = [r["entity_id"] for r in order.orderBy("ins_seq").select("entity_id").collect()]
        last = self.events.agg(F.coalesce(F.max("ins_seq"), F.lit(-1))).head()[0]
        row = spark.range(1).select(
            F.sha2(F.lit(f"{fact}|{now.isoformat()}"), 256).alias("id"), F.array(*map(F.lit, ids[:1])).cast("array<string>").alias("subject_ids"), F.array(*map(F.lit, ids[1:])).cast("array<string>").alias("object_ids"),
            F.lit("remembered").alias("predicate"), F.lit(fact).alias("normalized_text"), F.lit("").alias("details"), F.lit(time_expr).alias("time_expr"), F.lit(None).cast("timestamp").alias("event_time"),
            F.lit("unknown").alias("event_time_precision"), F.lit(now).cast("timestamp").alias("mention_time"), F.lit("direct").alias("source_session"), F.lit(-1).alias("source_turn"), F.lit(False).alias("speech_act"),
            F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(last + 1).cast("long").alias("ins_seq"),
        )
        return row.select(*[c.split()[0] for c in EVENT.split(", ")])

    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes = self.entities.select(F.col("id").alias("entity_id"), "canonical_name", "type").join(graph.degrees(self.events), "entity_id", "left").fillna(0, ["degree"])
        return nodes, graph.links(self.events)

    def status(self, log: DataFrame | None = None, settings: dict | None = None, models: dict[str, bool] | None = None) -> DataFrame:
        """(key, value): counts and span of the graph; with a job log its backlog, failures
        and last error; settings in force; which models answer."""
        e = self.entities.agg(F.count("*").alias("entities"))
        v = self.events.agg(F.count("*").alias("events"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.count_if(F.col("embedding").isNull()).alias("without_vector"), F.min("mention_time").cast("string").alias("first"), F.max("mention_time").cast("string").alias("last"))
        row = e.crossJoin(F.broadcast(v))
        if log is not None:
            last = jobs.fold(log).agg(F.max_by("last_error", "last_at").alias("last_error"))
            row = row.crossJoin(F.broadcast(jobs.counts(log))).crossJoin(F.broadcast(last))
        given = {f"setting {k}": str(v) for k, v in (settings or {}).items()} | {f"model {k}": "answers" if v else "none" for k, v in (models or {}).items()}
        pairs = [x for c in row.columns for x in (F.lit(c), F.col(c).cast("string"))] + [F.lit(x) for kv in given.items() for x in kv]
        return row.select(F.explode(F.create_map(*pairs)).alias("key", "value"))

    def context_block(self, query: str, anchor: datetime, max_chars: int = 2000, via: int = 5) -> str:
        """Lines for a prompt: the answer's facts and then up to `via` facts that share an
        entity with the first of them, at most two steps away; near copies of a line
        aren't repeated."""
        found = self.retrieve(query, anchor, 8)
        if not found:
            return ""
        order = list(dict.fromkeys([*(r["id"] for r in found), *(e["id"] for e, _ in self.neighbors(found, via, 2))])) if via else [r["id"] for r in found]
        line = memory_line(F.col("time_expr"), F.col("event_time"), F.col("mention_time"), F.col("normalized_text"), F.col("details"), F.col("superseded_by"))
        rows = {r["id"]: r for r in self.events.where(F.col("id").isin(order)).select("id", line.alias("line"), "normalized_text").collect()}
        lines = [(rows[i]["line"], set(query_words(rows[i]["normalized_text"]))) for i in order if i in rows]
        return "\n".join(rerank.pack_lines(lines, max_chars))

    def replay(self, questions: DataFrame, anchor: datetime, top_k: int = 10) -> DataFrame:
        """(question, rank) of questions (question, answer): the place of the first fact
        retrieved that holds the answer.  Each question is a retrieval of its own."""
        rows = [(q["question"], i, r["normalized_text"]) for q in questions.select("question").distinct().toLocalIterator() for i, r in enumerate(self.retrieve(q["question"], anchor, top_k), 1)]
        ranked = self.events.sparkSession.createDataFrame(rows, "question string, place int, fact string")
        return evaluation.gold_rank(ranked, questions)


class Graph:
    """Changes to a graph as journal records (v, op, data): append them to write them."""

    def __init__(self, entities: DataFrame, events: DataFrame):
        self.entities, self.events = entities, events

    def resolve(self, mentions: DataFrame, now: datetime, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
        """mentions (name, type, seq, and aliases and embedding if there are), each with id and
        created, and the records of entities that are new or gain an alias.  A name or
        alias resolves a mention; else, where there are vectors, the nearest entity of
        a cosine of at least threshold does."""
        resolved, fresh = graph.resolve_or_create(mentions, self.entities)
        if "embedding" in mentions.columns:
            asked = resolved.where("created AND embedding IS NOT NULL").select(F.col("id"), F.col("embedding").alias("v")).dropDuplicates(["id"])
            near = vectors.nearest(asked, self.entities.where("embedding IS NOT NULL").select("id", F.col("embedding").alias("v")), threshold)
            near = near.select(F.col("query_id").alias("id"), F.col("near_id").alias("_near"))
            resolved = resolved.join(near, "id", "left").withColumns({"created": F.col("created") & F.col("_near").isNull(), "id": F.coalesce("_near", "id")}).drop("_near")
            fresh = fresh.join(near, "id", "left_anti")
        stamp = F.lit(now).cast("timestamp")
        made = fresh.withColumns({"aliases": F.array().cast("array<string>"), "created_at": stamp, "modified_at": stamp})
        if "embedding" in mentions.columns:
            made = made.join(mentions.withColumn("id", F.sha2(norm_name(F.col("name")), 256)).groupBy("id").agg(F.min_by("embedding", "seq").alias("embedding")), "id", "left")
        old = graph.accrete(resolved, self.entities).withColumn("modified_at", stamp)
        # what a new entity's own mentions call it besides
        own = graph.accrete(resolved, made)
        new = made.join(own.select("id"), "id", "left_anti").unionByName(own)
        return resolved, graph.records("entity.upsert", new).union(graph.records("entity.upsert", old))

    def add_events(self, events: DataFrame) -> DataFrame:
        return graph.records("event.add", events)

    def link(self, links: DataFrame) -> DataFrame:
        """links (id, subject_ids, object_ids) take the place of the events' own."""
        return self._changed(links, ["subject_ids", "object_ids"])

    def set_embeddings(self, vectors_: DataFrame) -> DataFrame:
        """(id, embedding) of events."""
        return self._changed(vectors_, ["embedding"])

    def mark(self, marks: DataFrame) -> DataFrame:
        """marks (old_id, new_id, seq); those of unknown events change nothing."""
        marked = graph.mark_superseded(self.events, marks)
        old = self.events.select("id", F.col("superseded_by").alias("_was"))
        return graph.records("event.add", marked.join(old, "id").where(~F.col("superseded_by").eqNullSafe(F.col("_was"))))

    def delete_entity(self, entity_id: str) -> DataFrame:
        """The entity goes, and events that held it are written without it."""
        held = F.array_contains("subject_ids", entity_id) | F.array_contains("object_ids", entity_id)
        gone = graph.records("entity.delete", self.entities.where(F.col("id") == entity_id).select("id"))
        return gone.union(graph.records("event.add", graph.delete_entity(self.entities, self.events.where(held), entity_id)[1]))

    def delete_event(self, event_id: str) -> DataFrame:
        return graph.records("event.delete", self.events.where(F.col("id") == event_id).select("id"))

    def _changed(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        return graph.records("event.add", self.events.drop(*columns).join(rows.select("id", *columns), "id"))

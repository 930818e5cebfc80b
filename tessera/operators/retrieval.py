"""Hybrid ranked retrieval: one DataFrame plan from candidates to top k.

Query-side work (words, operator, vector) is done on the driver and enters as
literals.  Vectors are only read for the dense slice.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.temporal import TemporalOp
from ..functions.text import array_of, matched_stems, state_family

SPEECH, SUPERSEDED, BUCKET = 0.3, 0.3, 0.25
ENTITY_BONUS, OVERLAP, EXPANSION, EXPANSION_CAP, DESCRIPTOR = 0.5, 2.0, 0.25, 2.0, 0.5
TOPIC_RATE, TOPIC_CAP, TOPIC_ANCHORS, TURN_ANCHORS = 0.25, 1.8, 10, 5
HOP_HITS, HOP_EVENTS = 15, 200
TOPIC_TYPES = ("OBJECT", "CONCEPT")


def speech_factor(speech: Column) -> Column:
    return F.when(F.coalesce(speech, F.lit(False)), SPEECH).otherwise(1.0)


def document_frequency(pool: DataFrame, stems: str = "stems") -> DataFrame:
    return pool.select(F.explode(stems).alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def query_idf(pool: DataFrame, words: list[str], stems: str = "stems") -> Column:
    """A map literal-like column stem -> idf of the query's stems over the pool, as
    one row to broadcast: as wide as the query, whatever the pool."""
    held = [F.count_if(F.array_contains(stems, w)).alias(f"w{i}") for i, w in enumerate(words)]
    return pool.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), *held).select(F.array(*[idf(F.col(f"w{i}"), F.col("n")) for i in range(len(words))]).alias("idfs") if words else F.expr("cast(array() as array<double>)").alias("idfs"))


def keyword_scores(pool: DataFrame, query: list[str], expansion: list[str] = (), descriptors: list[str] = ()) -> DataFrame:
    """overlap, coverage, mass, expansion_bonus and descriptor_bonus of each event
    of the pool (column stems); idf is of the pool itself."""
    extra = [w for w in expansion if w not in query]
    more = [w for w in descriptors if w not in query and w not in extra]
    words = [*query, *extra, *more]
    scored = pool.crossJoin(F.broadcast(query_idf(pool, words)))

    def total(some: list[str], held: bool = True) -> Column:
        out = F.lit(0.0)
        for w in some:
            v = F.col("idfs")[words.index(w)]
            out = out + (F.when(F.array_contains("stems", w), v).otherwise(0.0) if held else v)
        return out

    every = total([*query, *extra], False)
    matched = F.size(F.array_intersect("stems", array_of(query))) if query else F.lit(0)
    return scored.withColumns(
        {
            "overlap": total([*query, *extra]) / F.when(every == 0, 1.0).otherwise(every),
            "coverage": matched / F.lit(max(1, len(query))),
            "mass": total([*query, *extra]),
            "expansion_bonus": F.least(EXPANSION * total(extra), F.lit(EXPANSION_CAP)),
            "descriptor_bonus": DESCRIPTOR * total(list(descriptors)),
        }
    ).drop("idfs")


def dense_slice(events: DataFrame, query_vector: list[float] | None, words: list[str], n: int) -> DataFrame:
    """The n first by cosine, or by raw overlap where there's no vector, each less
    for speech; only then are scores that aren't positive dropped."""
    raw = F.size(matched_stems(F.col("event_text"), words)).cast("double") if words else F.lit(0.0)
    if query_vector is None:
        score = raw
    else:
        vector = F.array(*[F.lit(float(x)) for x in query_vector])
        usable = F.col("embedding").isNotNull() & (F.size("embedding") == len(query_vector))
        score = F.when(usable, vectors.cosine(F.col("embedding").cast("array<double>"), vector)).otherwise(raw)
    return events.withColumn("dense", score * speech_factor(F.col("speech_act"))).orderBy(F.desc("dense"), "ins_seq").limit(n).where("dense > 0")


def candidate_union(*lists: DataFrame) -> DataFrame:
    """(id, place) of ranked lists (id, place) put one after another: an id keeps its
    first place."""
    every = None
    for i, part in enumerate(lists):
        part = part.select("id", F.struct(F.lit(i).alias("list"), F.col("place")).alias("place"))
        every = part if every is None else every.union(part)
    return every.groupBy("id").agg(F.min("place").alias("place"))


def within_budget(lines: DataFrame, group: str, order: str, length: str, most: int) -> DataFrame:
    """Lines of each group, in order, up to the first that would pass `most`; used: the
    length so far."""
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    used = lines.withColumn("used", F.sum(length).over(so_far))
    over = F.max((F.col("used") > most).cast("int")).over(so_far)
    return used.withColumn("_over", over).where("_over = 0").drop("_over")


def latest(events: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest event of each group, the larger `tie` of equal ones."""
    return events.groupBy(*keys).agg(F.max(F.struct(time, tie)).alias("_b")).select(*keys, F.col(f"_b.{tie}").alias(tie), F.col(f"_b.{time}").alias(time))


def temporal_pool(pool: DataFrame, every: DataFrame, op: TemporalOp) -> DataFrame:
    """The pool's events that meet the operator; if none does, all events that do."""
    if not op.filters:
        return pool
    near = pool.where(op.match(F.col("event_time"), F.col("mention_time")).isNotNull())
    none = near.agg((F.count("*") == 0).alias("_none"))
    rest = every.where(op.match(F.col("event_time"), F.col("mention_time")).isNotNull()).crossJoin(F.broadcast(none)).where("_none").drop("_none")
    return near.unionByName(rest, allowMissingColumns=True)


def one_hop(hits: DataFrame, bridge: DataFrame) -> DataFrame:
    """Distinct events that share an entity with hits (event_id): the first
    HOP_EVENTS of each entity by insertion."""
    topics = bridge.join(F.broadcast(hits.select("event_id").distinct()), "event_id", "left_semi").select("entity_id").distinct()
    near = bridge.join(topics, "entity_id", "left_semi").select("entity_id", "event_id", "ins_seq").distinct()
    first = Window.partitionBy("entity_id").orderBy("ins_seq", "event_id")
    return near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= HOP_EVENTS).select("event_id").distinct()


def compose(scored: DataFrame, op: TemporalOp) -> DataFrame:
    """score from its parts (dense, overlap, bonuses, mentioned), before locality."""
    base = F.coalesce("dense", F.lit(0.0)) + OVERLAP * F.col("overlap") + F.col("expansion_bonus") + F.col("descriptor_bonus")
    base = base + F.when(F.col("mentioned"), ENTITY_BONUS).otherwise(0.0) + op.bonus(F.col("event_time"), F.col("mention_time"))
    stale = F.when(F.col("superseded_by").isNotNull(), SUPERSEDED).otherwise(1.0) if not op.filters else F.lit(1.0)
    return scored.withColumn("score", base * speech_factor(F.col("speech_act")) * stale)


def turn_boost(gap: Column, score: Column) -> Column:
    """Boost for an event `gap` turns after an anchor of that score, by distance."""
    caps = ((0, 1.8, 0.22), (1, 1.5, 0.2), (-1, 1.2, 0.15), (2, 1.0, 0.12), (-2, 0.7, 0.09))
    out = F.lit(0.0)
    for at, cap, rate in caps:
        out = F.when(gap == at, F.least(F.lit(cap), rate * score)).otherwise(out)
    return out


def locality(scored: DataFrame, session: str = "source_session", turn: str = "source_turn", anchors: int = TURN_ANCHORS) -> DataFrame:
    """turn_boost: the best over the top anchors of the same session within two
    turns.  Rows without a session, or of no turn (a negative one), are neither
    boosted nor anchors.  The anchors are a handful of rows, so they are broadcast."""
    of_turn = lambda s, t: (F.col(s).cast("string") != "") & (F.col(t) >= 0)
    top = scored.orderBy(F.desc("score"), "ins_seq").limit(anchors).select(F.col(session).alias("_s"), F.col(turn).alias("_t"), F.col("score").alias("_score")).where(of_turn("_s", "_t"))
    near = (F.col(session) == F.col("_s")) & F.abs(F.col(turn) - F.col("_t")).between(0, 2) & of_turn(session, turn)
    ids = [c for c in scored.columns if c == "id"]
    joined = scored.join(F.broadcast(top), near).groupBy(*ids).agg(F.max(turn_boost(F.col(turn) - F.col("_t"), F.col("_score"))).alias("turn_boost"))
    return scored.join(joined, "id", "left").withColumn("turn_boost", F.coalesce("turn_boost", F.lit(0.0)))


def topic_boost(scored: DataFrame, bridge: DataFrame, entities: DataFrame, anchors: int = TOPIC_ANCHORS) -> DataFrame:
    """topic_boost: by the best of the top anchors that shares a topic, an entity
    (id, type) that is no person."""
    topics = entities.where(F.col("type").isin(*TOPIC_TYPES)).select(F.col("id").alias("entity_id"))
    bridge = bridge.join(topics, "entity_id", "left_semi")
    top = scored.orderBy(F.desc("score"), "ins_seq").limit(anchors).select(F.col("id").alias("event_id"), F.col("score").alias("_score"))
    topics = bridge.join(F.broadcast(top), "event_id").groupBy("entity_id").agg(F.max("_score").alias("_score"))
    best = bridge.join(F.broadcast(topics), "entity_id").groupBy(F.col("event_id").alias("id")).agg(F.max("_score").alias("_score"))
    boost = F.when(F.col("_score").isNotNull(), F.least(F.lit(TOPIC_CAP), TOPIC_RATE * F.col("_score")))  # least skips nulls
    return scored.join(best, "id", "left").withColumn("topic_boost", F.coalesce(boost, F.lit(0.0))).drop("_score")


def bucket(score: Column) -> Column:
    """Rounded half up, so near ties are decided by coverage."""
    return F.floor(score / BUCKET + 0.5)


def ranked(scored: DataFrame) -> list[Column]:
    return [F.desc(bucket(F.col("score"))), F.desc("coverage"), F.desc("mass"), F.desc("score"), F.asc("ins_seq")]


def dedup_state(scored: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Of state events of one (first subject, family), the newest mention stays;
    ties go to the one ranked first.  Others pass."""
    family = state_family(F.col("predicate"))
    subject = F.try_element_at("subject_ids", F.lit(1))
    newest = Window.partitionBy(subject, family).orderBy(F.desc("mention_time"), *(order or ranked(scored)))
    return scored.withColumns({"_family": family, "_n": F.row_number().over(newest)}).where("_family IS NULL OR _n = 1").drop("_family", "_n")


def parse_anchor(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", ""))

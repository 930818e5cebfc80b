"""Evaluation: accuracy, recall attribution, usage, audits, corpus features."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import array_of, literal_kind, words_of
from .graph import contained

# Fixed value: tool arguments that look like reading the evaluation's own data.
SUSPICIOUS = r"(?i)(answers?\.json|ground[_ -]?truth|benchmark|\.jsonl)"


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 4)).otherwise(0.0)


def accuracy(judged: DataFrame, kind: str, correct: str) -> DataFrame:
    """Of each kind and over all (kind ALL)."""
    return judged.rollup(kind).agg(F.count("*").alias("n"), F.round(F.avg(F.col(correct).cast("double")), 4).alias("accuracy")).withColumn(kind, F.coalesce(kind, F.lit("ALL")))


def attribution(results: DataFrame, config: str = "config") -> DataFrame:
    """Per config and over all: where the answer was found, and accuracy there."""
    n = F.count("*")
    return results.rollup(config).agg(
        n.alias("n"),
        F.count_if(F.col("recall") == "injected").alias("injected"),
        F.count_if(F.col("recall") == "searched").alias("searched"),
        F.count_if(F.col("recall") == "never").alias("never"),
        percent(F.count_if(F.col("recall") != "never"), n).alias("recall_pct"),
        percent(F.count_if(F.col("correct") & (F.col("recall") == "injected")), F.count_if(F.col("recall") == "injected")).alias("injected_acc"),
    ).withColumn(config, F.coalesce(config, F.lit("ALL")))


def usage(calls: DataFrame, kind: str, amount_in: str, amount_out: str) -> DataFrame:
    """Sums and whole-number means by kind."""
    n = F.count("*")
    return calls.groupBy(kind).agg(n.alias("calls"), F.sum(amount_in).alias("input"), F.sum(amount_out).alias("output"), F.floor(F.sum(amount_in) / n).alias("avg_input"))


def mean_metrics(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Means, times 100 unless the metric is a length or a time."""
    scale = F.when(F.col(name).rlike("_(len|time)$"), 1.0).otherwise(100.0)
    return rows.groupBy(name).agg(F.avg(value).alias("_m")).select(name, F.round(F.col("_m") * scale, 4).alias("mean"))


def literal_audit(names: DataFrame) -> DataFrame:
    """names (name, in_subject): literal entities by kind and side."""
    side = F.when(F.col("in_subject"), "subject").otherwise("object")
    return names.withColumns({"kind": literal_kind(F.col("name")), "side": side}).where("kind IS NOT NULL").groupBy("kind", "side").agg(F.count("*").alias("n"))


def corpus_features(c: Column) -> dict[str, Column]:
    """Counts by pattern; a pattern is only looked for where what it needs is there."""
    digits = F.length(c) - F.length(F.translate(c, "0123456789", ""))
    return {
        "chars": F.length(c),
        "digits": digits,
        "versions": F.when(digits > 1, F.regexp_count(c, F.lit(r"[0-9]+\.[0-9]+(?:\.[0-9]+)*"))).otherwise(0),
        "list_lines": F.regexp_count(c, F.lit(r"(?m)^\s*(?:[-*]|[0-9]+\.)\s")),
        "identifiers": F.when(c.rlike("_|[a-z][A-Z]"), F.regexp_count(c, F.lit(r"[A-Za-z]+_[A-Za-z_]+|[a-z]+[A-Z][A-Za-z]+"))).otherwise(0),
        "cjk_pct": F.when(F.length(c) > 0, F.round(100.0 * F.regexp_count(c, F.lit("[一-鿿]")) / F.length(c), 2)).otherwise(0.0),
    }


def is_chinese_fact(c: Column) -> Column:
    """Four CJK characters or more, and a quarter of what isn't white space."""
    n = F.regexp_count(c, F.lit("[一-鿿]"))
    return (n >= 4) & (4 * n >= F.length(F.regexp_replace(c, r"\s", "")))


@F.pandas_udf(T.StringType())
def fold_text(texts: pd.Series) -> pd.Series:
    """Compatibility form without marks, lower case, other signs as spaces."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c.isascii() and c.isalnum() or "一" <= c <= "鿿" else " " for c in bare).split())

    return texts.map(one)


def verifiable(answer: Column) -> Column:
    """Long enough to be looked up, and not a bare number."""
    return (F.length(answer) >= 4) & ~answer.rlike(r"^[0-9]+$")


def answer_support(answers: DataFrame, facts: DataFrame, words: list[str]) -> DataFrame:
    """(answer, strong, weak): facts that contain the answer, with or without a word
    of the question."""
    strong = F.arrays_overlap(words_of(F.col("fact")), array_of(words)) if words else F.lit(False)
    named = answers.select(F.col("answer").alias("key"), F.col("answer").alias("name"))
    held = contained(facts.select("fact", strong.alias("_strong")), "fact", named, keep=["_strong"]).withColumnRenamed("key", "answer")
    return held.groupBy("answer").agg(F.count_if("_strong").alias("strong"), F.count_if(~F.col("_strong")).alias("weak"))


def tool_audit(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Per tool: calls, failures (an error or no result) and suspicious arguments."""
    joined = calls.join(results.select("call_id", "is_error"), "call_id", "left")
    failed = F.coalesce(F.col("is_error"), F.lit(True))
    return joined.groupBy("name").agg(F.count("*").alias("calls"), F.count_if(failed).alias("failed"), F.count_if(F.col("arguments").rlike(SUSPICIOUS)).alias("suspicious"))


def paired(hypotheses: DataFrame, references: DataFrame) -> DataFrame:
    """Rows with the same position pos; where lengths differ, by normalized question
    (the first reference of a question counts)."""
    lengths = hypotheses.agg(F.count("*").alias("a")).crossJoin(references.agg(F.count("*").alias("b"))).select((F.col("a") == F.col("b")).alias("same"))
    by_pos = hypotheses.join(references.select("pos", F.col("answer").alias("reference")), "pos").crossJoin(F.broadcast(lengths)).where("same").drop("same")
    first = references.groupBy("question").agg(F.min_by("answer", "pos").alias("reference"))
    by_text = hypotheses.join(first, "question").crossJoin(F.broadcast(lengths)).where("NOT same").select(*hypotheses.columns, "reference")
    return by_pos.select(*hypotheses.columns, "reference").unionByName(by_text)


def turn_quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per turn: rows, short facts, literal names, exact repeats, most rows of one
    entity, share of Chinese facts."""
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy(*keys, "canonical", "predicate", "fact").orderBy("row_no"))
    per = F.count("*").over(Window.partitionBy(*keys, F.lower("canonical")))
    marked = rows.withColumns({"_again": again, "_per": per, "_kind": literal_kind(F.col("canonical"))})
    n = F.count("*")
    return marked.groupBy(*keys).agg(
        n.alias("rows"),
        F.count_if(F.length("fact") < 12).alias("short_facts"),
        F.count_if(F.col("_kind").isNotNull()).alias("literal_rows"),
        F.count_if(F.col("_again") > 1).alias("repeats"),
        F.max("_per").alias("max_rows_per_entity"),
        F.round(F.avg(is_chinese_fact(F.col("fact")).cast("double")), 4).alias("chinese_share"),
    )


# Kinds of literals that no turn can be about, and those that one can.
HARD, SOFT = ("number", "version", "boolean", "quantity"), ("camelCase", "SCREAMING_SNAKE", "filename", "path")
# Labels of speakers, and the opening words of an echoed header.
SPEAKER_LABELS = r"(?i)^(?:user|assistant|goal|schedule|system|ai)$"
HEADER = r"(?i)ENTITY_TYPE|CANONICAL_NAME|ALIASES\|PREDICATE"
COLUMNS = 9


def score_outputs(outputs: DataFrame, keys: list[str], names: list[str] = ()) -> DataFrame:
    """Metrics of saved model outputs (keys, reply, turn_text), without calling a model
    again: per turn counts of lines, parse failures, literals by hardness, duplicates,
    the largest share of one entity, language match and coverage of the given names
    (null where the turn mentions none, or isn't Chinese)."""
    from .extraction import parse_rows

    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    lines = F.filter(F.transform(F.split("reply", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    pipes = F.filter(lines, lambda x: F.contains(x, F.lit("|")))
    listed = array_of([n.lower() for n in names]) if names else F.expr("cast(array() as array<string>)")
    mentioned = F.filter(F.transform(listed, bare), lambda n: F.contains(bare(F.col("turn_text")), n))
    chinese = F.when(F.length("turn_text") > 0, F.regexp_count("turn_text", F.lit("[一-鿿]")) / F.length("turn_text")).otherwise(0.0) >= 0.15
    raw = outputs.select(
        *keys,
        F.length("reply").alias("raw_chars"),
        F.size(lines).alias("raw_lines"),
        F.size(pipes).alias("pipe_lines"),
        F.size(F.filter(pipes, lambda x: F.size(F.split(x, r"\|", -1)) != COLUMNS)).alias("column_mismatch"),
        F.size(F.filter(lines, lambda x: x.rlike(HEADER))).alias("header_echo"),
        F.size(mentioned).alias("mentioned_names"),
        mentioned.alias("_mentioned"),
        chinese.alias("_chinese"),
    )
    rows = parse_rows(outputs.withColumns({"_mentioned": mentioned, "_chinese": chinese}).drop("turn_text"))
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy(*keys, F.lower("canonical"), F.lower("predicate"), "fact").orderBy("row_no"))
    per = F.count("*").over(Window.partitionBy(*keys, F.lower("canonical")))
    own = F.array_intersect(F.array_distinct(F.transform(F.concat(F.array("canonical"), "aliases"), bare)), F.col("_mentioned"))
    marked = rows.withColumns({"_again": again, "_per": per, "_kind": literal_kind(F.col("canonical")), "_own": own})
    n = F.count("*")
    found = marked.groupBy(*keys).agg(
        n.alias("events"),
        F.count_distinct(F.lower("canonical")).alias("entities"),
        F.count_if(F.col("_kind").isNotNull()).alias("literal_rows"),
        F.count_if(F.col("_kind").isin(*HARD)).alias("hard_literal_rows"),
        F.count_if(F.col("_kind").isin(*SOFT)).alias("soft_literal_rows"),
        F.count_if(F.trim("canonical").rlike(SPEAKER_LABELS)).alias("speaker_rows"),
        F.count_if((F.col("predicate") == "") | (F.col("fact") == "")).alias("empty_core"),
        F.count_if(F.col("_again") > 1).alias("duplicate_rows"),
        F.max("_per").alias("max_rows_per_entity"),
        F.sum(F.length("fact")).alias("fact_chars"),
        F.count_if(is_chinese_fact(F.col("fact"))).alias("chinese_facts"),
        F.count_if(F.size("_own") >= 2).alias("collapsed_rows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_own")))).alias("names_found"),
    )
    zero = [c for c in found.columns if c not in keys]
    out = raw.join(found, keys, "left").fillna(0, zero)
    return out.withColumns(
        {
            "parse_fail_lines": F.greatest(F.lit(0), F.col("pipe_lines") - F.col("events")),
            "language_match": F.when(F.col("_chinese") & (F.col("events") > 0), F.round(F.col("chinese_facts") / F.col("events"), 4)),
            "name_coverage": F.when(F.col("mentioned_names") > 0, F.round(F.col("names_found") / F.col("mentioned_names"), 4)),
        }
    ).drop("_mentioned", "_chinese")


SUMS = ("events", "entities", "literal_rows", "hard_literal_rows", "soft_literal_rows", "speaker_rows", "empty_core", "duplicate_rows", "collapsed_rows", "parse_fail_lines", "column_mismatch", "header_echo")


def quality_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Scored turns by group: sums, means a turn, rates over all rows, and coverage and
    language match over those turns only that have them."""
    rate = lambda part, whole: F.when(F.sum(whole) > 0, F.round(F.sum(part) / F.sum(whole), 4)).otherwise(0.0)
    covered, chinese = F.col("name_coverage").isNotNull(), F.col("language_match").isNotNull()
    return scored.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        *[F.sum(c).alias(c) for c in SUMS],
        F.round(F.avg("events"), 1).alias("events_per_turn"),
        F.round(F.avg("entities"), 1).alias("entities_per_turn"),
        rate("literal_rows", "events").alias("literal_rate"),
        rate("speaker_rows", "events").alias("speaker_rate"),
        F.max("max_rows_per_entity").alias("max_rows_per_entity"),
        F.when(F.sum(F.when(chinese, F.col("events"))) > 0, F.round(F.sum(F.when(chinese, F.col("chinese_facts"))) / F.sum(F.when(chinese, F.col("events"))), 4)).alias("language_match"),
        F.when(F.sum(F.when(covered, F.col("mentioned_names"))) > 0, F.round(F.sum(F.when(covered, F.col("names_found"))) / F.sum(F.when(covered, F.col("mentioned_names"))), 4)).alias("name_coverage"),
    )


def histogram(rows: DataFrame, categories: str) -> DataFrame:
    """(category, n) of a list column, most frequent first."""
    return rows.select(F.explode(categories).alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def wrong_merges(decisions: DataFrame, profile: str = "profile") -> DataFrame:
    """decisions (profile, target, expected): per profile how many merges, how many into
    another entity than expected (none expected included), and how many were missed."""
    merged, right = F.col("target").isNotNull(), F.col("target").eqNullSafe(F.col("expected"))
    return decisions.groupBy(profile).agg(F.count_if(merged).alias("merges"), F.count_if(merged & ~right).alias("wrong"), F.count_if(~merged & ~right).alias("missed"))


def query_volume(events: DataFrame) -> DataFrame:
    """events, and extracted: those that a turn made."""
    return events.agg(F.count("*").alias("events"), F.count_if(F.coalesce(F.col("source_turn"), F.lit(-1)) >= 0).alias("extracted"))


def require_extracted(events: DataFrame) -> None:
    """Stop before questions are put to a graph that no turn wrote to."""
    row = query_volume(events).head()
    if not row["extracted"]:
        raise RuntimeError(f"no events extracted from turns (of {row['events']}); the graph is not ready to be asked")


def unwrapped(c: Column, marker: str = "Now Answer the Question:") -> Column:
    """The question of a wrapped prompt: what follows the marker, without a closing
    `Answer:`, white space collapsed, in lower case."""
    at = F.instr(c, marker)
    rest = F.when(at > 0, F.substring(c, at + len(marker), F.length(c))).otherwise(c)
    bare = F.regexp_replace(rest, r"\s*Answer:\s*$", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Least, mean and largest by key, to six digits."""
    return rows.groupBy(key).agg(*[F.round(f(value), 6).alias(n) for f, n in ((F.min, "lo"), (F.avg, "mean"), (F.max, "hi"))])


def freeze(records: DataFrame, path: str, key: str) -> int:
    """Write a corpus as JSON; one that would lose records of the corpus there is refused."""
    spark = records.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if there:
        lost = spark.read.json(path).select(key).join(records.select(key), key, "left_anti").count()
        if lost:
            raise ValueError(f"{lost} records of the corpus at {path} would be lost")
    fresh = f"{path}.new"
    records.write.mode("overwrite").json(fresh)
    kept = spark.read.json(fresh).count()
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if there:
        fs.delete(where, True)
    fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), where)
    return kept


def gold_rank(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(question, rank): the first place of a ranked list (question, place, fact) that holds
    the answer of gold (question, answer), or null."""
    hit = ranked.join(gold, "question").where(F.contains(F.lower("fact"), F.lower("answer"))).groupBy("question").agg(F.min("place").alias("rank"))
    return gold.select("question").distinct().join(hit, "question", "left")


def strided(questions: DataFrame, index: str, step: int, offset: int = 0) -> DataFrame:
    """Every step-th question, from the offset on: a sampling operator."""
    return questions.where((F.col(index) >= offset) & (F.pmod(F.col(index) - offset, F.lit(step)) == 0))

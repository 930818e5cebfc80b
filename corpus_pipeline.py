"""Corpus preparation: five stages, each one operator of tessera.llm.

Every stage takes all that its predecessor kept; between stages the documents
are a written table.  Null texts count as empty and stay; an empty table passes
through all stages.  Extra columns pass as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, op1_line_dedup, op6_decontamination, op7_toxicity, op8_byte_bpe, op9_near_dedup


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    return op7_toxicity.accepted(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike, the first stays.  A document that had words and whose
    lines all stand elsewhere goes; one that was blank before stays."""
    return op1_line_dedup.line_dedup(docs, drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id."""
    return op9_near_dedup.kept_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows cover to a twentieth or more go; others stay as they are."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    kept = op6_decontamination.contamination(plain, common.table(spark, sf_dir, "benchmark"), carry=names).where(~F.col("contaminated"))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token ids, and digests that show the round trip."""
    import public_tokenizers as P

    return op8_byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, carry=[c for c in docs.columns if c != "doc_id"])


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: SQL can express neither the toxicity model nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.materialize(docs, f"stage-{name}")
    return docs

"""Registered queries against their SQL, and the pipeline as a whole."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tessera.llm import op9_near_dedup, queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (f[cols].sort_values("doc_id").reset_index(drop=True).astype(object) for f in (got, want))
    assert a.where(a.notna(), None).equals(b.where(b.notna(), None)) or pd.testing.assert_frame_equal(a.where(a.notna(), None), b.where(b.notna(), None), check_dtype=False) is None


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        if name == "near_dedup":
            near = op9_near_dedup.near_components(docs)
            assert out.count() == near.where("kept").count()
            assert op9_near_dedup.near_components(out).where("NOT kept").count() == 0
        docs = out.persist()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert last.count() == docs.count() and {"doc_id", "ids", "n_tokens"} <= set(last.columns)


def test_stages_of_awkward_tables(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, an empty table, and columns whose names the stages use themselves."""
    words = "the river runs along old stones and green fields until night falls over quiet houses".split()
    text = lambda k: " ".join(words[(k * 5 + 3 * i) % len(words)] + str(k * i % 11) for i in range(40))
    rows = [(i, text(i)) for i in range(12)] + [(20, None), (21, ""), (22, " \n "), (23, text(3)), (24, text(3)[:-1] + "?"), (25, "\n".join(text(k) for k in range(400, 900))), (None, text(5)), (None, None), (4, text(4)), (4, text(4))]
    extra = "_text _doc _gone predicted score n_words spans items contaminated removed left mark doc component kept c0 d0 line ids n_tokens".split()
    full = [(i, t, "en", None, len(t or ""), *[f"{c}-{n}" for c in extra]) for n, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    spark.createDataFrame([(i, int(i % 4 == 1), int(i % 5 == 0)) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "absent words"), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table_ in (spark.createDataFrame(full, schema), spark.createDataFrame([], schema)):
        docs = table_
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path)).persist()
            assert out.columns == docs.columns
            given = {r["_text"]: r.asDict() for r in docs.collect()}
            for r in out.collect():
                assert all(r[c] == given[r["_text"]][c] for c in ["doc_id", "lang", *extra])
            docs = out
        last = corpus_pipeline.byte_bpe(spark, docs, str(tmp_path))
        assert last.count() == docs.count()
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    whole = spark.createDataFrame(full, schema)
    deduped = ids(corpus_pipeline.line_dedup(spark, whole, str(tmp_path)))
    assert (False, 23) not in deduped and (False, 24) not in deduped and deduped.count((False, 4)) == 3
    assert {(False, 20), (False, 21), (False, 22)} <= set(deduped)
    near = ids(corpus_pipeline.near_dedup(spark, whole, str(tmp_path)))
    assert (False, 23) not in near and (False, 20) in near and near.count((True, 0)) == 2
    assert corpus_pipeline.decontamination(spark, whole.where(F.col("doc_id") == 1), str(tmp_path)).count() == 1

import json
import re

from pyspark.sql import functions as F

from tessera.operators import models
from tessera.sources.html import page


def test_fallback_chain(spark):
    def fails(texts):
        raise RuntimeError("down")

    def some(texts):
        return [None if "b" in t else [1.0, 2.0] for t in texts]

    def last(texts):
        return [[3.0] if t else None for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, t string")
    got = {r["id"]: (r["embedding"], r["backend"]) for r in models.embed(df, "t", [fails, some, last], 2).collect()}
    assert got == {1: ([1.0, 2.0], 1), 2: ([3.0], 2), 3: ([1.0, 2.0], 1)}
    stale = spark.createDataFrame([("x", "a", [1.0]), ("y", "a", [1.0, 2.0]), ("z", "a", None)], "id string, t string, embedding array<float>")
    assert sorted(r["id"] for r in models.backfill(stale, "t", [some], 2).collect()) == ["x", "z"]


def test_budget(spark):
    rows = spark.createDataFrame([(100.0, 2.5, True), (100.0, float("inf"), True), (100.0, 3.0, False), (100.0, 1.0, True)], "b double, h double, t boolean")
    assert [r[0] for r in rows.select(models.max_tokens(F.col("b"), F.col("h"), F.col("t"))).collect()] == [250, 100, 100, 100]


def test_page_escapes(spark):
    nodes = spark.createDataFrame([("a", "</script><b>", "PERSON", 2), ("b", "Bob", "PERSON", 1), ("c", "cut", "PERSON", 0)], "entity_id string, canonical_name string, type string, degree long")
    links = spark.createDataFrame([("e", "met", "a", "b"), ("f", "met", "a", "c")], "id string, predicate string, source string, target string")
    text = page(nodes, links, 2)
    held = re.search(r'application/json">(.*?)</script>', text)[1]
    assert "<" not in held and [x["target"] for x in json.loads(held)["links"]] == ["b"]


def test_mentions_of_equal_scores(spark):
    rows = [(i, 1, "Ann" if i % 2 else "ann", label, 0.9) for i, label in ((1, "b"), (2, "a"), (3, "c"), (0, "d"))] + [(4, 1, "bob", "b", 0.9), (5, 1, "bob", "a", 0.9), (6, 1, "bob", "c", 0.8)]
    labels = {"A": "OBJECT", "B": "PERSON", "C": "CONCEPT"}
    for found in (rows, rows[::-1]):
        df = spark.createDataFrame(found, "n long, k long, text string, label string, score double").repartition(1)
        assert {r["text"]: r["label"] for r in models.mentions(df, "k", labels, "n").collect()} == {"ann": "PERSON", "bob": "PERSON"}
        assert {r["text"]: r["label"] for r in models.mentions(df, "k", labels).collect()} == {"ann": "PERSON", "bob": "PERSON"}

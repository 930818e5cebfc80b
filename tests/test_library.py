"""Operators that SQL can't express or that write: plain versions, files, stubs."""

from __future__ import annotations

import json
import random
from datetime import datetime as D

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.api import Engine, Graph
from tessera.functions import text, timeexpr, vectors
from tessera.operators import conflict, evaluation, extraction, graph, jobs, models, retrieval
from tessera.schema import ENTITY, EVENT, JOB_LOG
from tessera.sources import audit, journal, profiles, sessions, settings, tensors
from tessera.streaming import inject

NOW = D(2026, 9, 1, 12)


def entity(i, name, kind="PERSON", aliases=(), vector=None):
    return f"n{i}", name, kind, list(aliases), NOW, NOW, vector, i


def event(i, subjects=(), objects=(), fact="", predicate="said", **more):
    row = {"id": f"e{i}", "subject_ids": list(subjects), "object_ids": list(objects), "predicate": predicate, "normalized_text": fact, "details": "", "time_expr": "", "event_time": None, "event_time_precision": "unknown", "mention_time": NOW, "source_session": "s1", "source_turn": 0, "speech_act": False, "superseded_by": None, "embedding": None, "ins_seq": i}
    return tuple((row | more).values())


def entities(spark, *rows):
    return spark.createDataFrame(rows, ENTITY)


def events(spark, *rows):
    return spark.createDataFrame(rows, EVENT)


# ---- journal ---------------------------------------------------------------


def test_journal_append_read_compact_replay(spark, tmp_path):
    path = str(tmp_path / "log")
    first = events(spark, *[event(i, fact=f"fact {i}") for i in range(40)]).withColumn("seq", F.col("ins_seq"))
    write = lambda df, op: journal.append(graph.records(op, df).withColumn("seq", F.substring("data.id", 2, 9).cast("long")), path)
    write(first.repartition(5), "event.add")
    write(first.where("ins_seq < 10").repartition(3), "event.delete")
    write(first.where("ins_seq = 3").withColumn("normalized_text", F.lit("again")), "event.add")
    records = journal.read_journal(spark, path)
    order = [(r["seq"], r["op"], r["data"]["id"]) for r in records.orderBy("seq").collect()]
    assert [s for s, _, _ in order] == list(range(51)) and [i for _, _, i in order[:40]] == [f"e{i}" for i in range(40)]
    live = {r["id"]: (r["normalized_text"], r["ins_seq"]) for r in journal.live(records, "event").collect()}
    assert set(live) == {"e3"} | {f"e{i}" for i in range(10, 40)} and live["e3"] == ("again", 50) and live["e10"] == ("fact 10", 10)
    journal.compact(records, str(tmp_path))
    assert {r["id"]: r["ins_seq"] for r in journal.read_current(spark, str(tmp_path), "events").collect()} == {k: v[1] for k, v in live.items()}
    assert {r["id"] for r in journal.scan_raw(spark, path).collect()} == {f"e{i}" for i in range(40)}  # deletes aren't looked at


def test_journal_numbers_lines_of_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"n": "{name}{i}"}}\n' if i % 5 else "\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = journal.numbered_lines(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["seq"] for r in rows] == list(range(4000))
    assert [json.loads(r["value"])["n"] for r in rows if r["value"]] == [f"{n}{i}" for n in "ab" for i in range(2000) if i % 5]


def test_journal_bulk_compacts_once(spark, tmp_path):
    j = journal.Journal(spark, str(tmp_path), compact_at=3)
    rows = lambda i: graph.records("event.add", events(spark, event(i, fact="f"), event(i + 1, fact="g")))
    with j.bulk():
        j.append(rows(0))
        with j.bulk():
            j.append(rows(2))
        assert j.snapshots == 0
    assert j.snapshots == 1 and journal.read_current(spark, str(tmp_path), "events").count() == 4
    j.append(rows(4))
    assert j.snapshots == 1 and j.records().count() == 6


# ---- graph -----------------------------------------------------------------


def test_contained_against_plain(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "ABC abc"]
    names = ["".join(rng.choice("abcÉ") for _ in range(rng.randrange(1, 4))) for _ in range(30)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    named = spark.createDataFrame(list(enumerate(names)), "key long, name string")
    want = {(i, k) for i, t in enumerate(texts) for k, n in enumerate(names) if n and n.lower() in (t or "").lower()}
    for block in (200_000, 7):
        got = [(r["i"], r["key"]) for r in graph.contained(df, "t", named, block).collect()]
        assert set(got) == want and len(got) == len(want)
    assert graph.contained(df, "t", named.where("false")).count() == 0


def test_contained_copies_in_pieces(spark, monkeypatch):
    """A long text isn't copied to each of its names at once, nor at all where it isn't kept."""
    words = [f"w{i:04}" for i in range(500)]
    df = spark.createDataFrame([(1, " ".join(words) * 20), (2, "w0001")], "i long, t string").repartition(1)
    named = spark.createDataFrame(list(enumerate(words)), "key long, name string")

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "bytes"])

    made = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema, *a, plain=type(df).mapInArrow, **k: made.setdefault("df", plain(self, lambda batches: seen(f(batches)), "n long, bytes long")))
    for keep, most in ((None, 8 << 20), (["i"], 1 << 20)):
        made.clear()
        graph.contained(df, "t", named, keep=keep)
        sizes = made["df"].collect()
        assert sum(r["n"] for r in sizes) == 501 and max(r["bytes"] for r in sizes) <= most + (1 << 20)


def test_lookup_by_name_and_type(spark):
    e = entities(spark, entity(0, "Ann", aliases=["Annie"]), entity(1, "Tea", "OBJECT"))
    asked = spark.createDataFrame([(" annie ",), ("TEA",), ("x",)], "n string")
    assert {r["n"]: r["id"] for r in graph.find_by_name(asked, "n", e).collect()} == {" annie ": "n0", "TEA": "n1", "x": None}
    assert {r["n"]: r["id"] for r in graph.find_by_name(asked, "n", e, "PERSON").collect()} == {" annie ": "n0", "TEA": None, "x": None}


def test_graph_records(spark, tmp_path):
    e = entities(spark, entity(0, "Ann", aliases=["Annie"], vector=[1.0, 0.0]), entity(1, "Bob", vector=[0.0, 1.0]))
    v = events(spark, event(0, ["n0"], ["n1"], "Ann met Bob"), event(1, ["n1"], [], "Bob slept"), event(2, [], [], "Bob met Annie", "remembered"))
    g, path = Graph(e, v), str(tmp_path / "log")
    mentions = spark.createDataFrame([("ann", "PERSON", ["Anna", "ANNIE", " Anna "], 0, [1.0, 0.0]), ("Bobby", "PERSON", [], 1, [0.05, 1.0]), ("Cleo", "CONCEPT", ["Cleopatra", "cleo"], 2, [1.0, 1.0]), ("CLEO ", "PERSON", ["Queen"], 3, [1.0, 1.0])], "name string, type string, aliases array<string>, seq long, embedding array<float>")
    resolved, rows = g.resolve(mentions, NOW)
    ids = {r["name"]: (r["id"], r["created"]) for r in resolved.collect()}
    assert ids["ann"] == ("n0", False) and ids["Bobby"] == ("n1", False) and ids["Cleo"][1] and ids["CLEO "][0] == ids["Cleo"][0]
    changed = {r["data"]["canonical_name"]: r["data"]["aliases"] for r in rows.collect()}
    assert changed == {"Ann": ["Annie", "Anna"], "Bob": ["Bobby"], "Cleo": ["Cleopatra", "Queen"]}
    journal.append(graph.records("entity.upsert", e), path)
    journal.append(g.add_events(v), path)
    journal.append(rows, path)
    journal.append(g.link(spark.createDataFrame([("e2", ["n0"], ["n1"])], "id string, subject_ids array<string>, object_ids array<string>")), path)
    journal.append(g.set_embeddings(spark.createDataFrame([("e1", [0.5])], "id string, embedding array<float>")), path)
    journal.append(g.mark(spark.createDataFrame([("e0", "e1", 0), ("e0", "e2", 1), ("e1", "none", 2)], "old_id string, new_id string, seq long")), path)
    journal.append(g.delete_event("e1"), path)
    records = journal.read_journal(spark, path)
    live = {r["id"]: r for r in journal.live(records, "event").collect()}
    assert set(live) == {"e0", "e2"} and live["e0"]["superseded_by"] == "e2" and live["e2"]["subject_ids"] == ["n0"] and live["e2"]["ins_seq"] == 4
    journal.append(Graph(e, journal.live(records, "event")).delete_entity("n1"), path)
    records = journal.read_journal(spark, path)
    assert {r["id"]: r["object_ids"] for r in journal.live(records, "event").collect()} == {"e0": [], "e2": []}
    assert journal.live(records, "entity").where("id = 'n1'").count() == 0


def test_orphans_and_retro_link(spark):
    e = entities(spark, entity(0, "Ann"), entity(1, "Bob", aliases=["Robert"]), entity(2, "A"))
    v = events(spark, event(0, [], [], "robert met ann", "remembered"), event(1, ["n0"], [], "Bob", "remembered"), event(2, [], [], "Bob", "said"), event(3, [], [], "nobody", "remembered"))
    assert [r["id"] for r in graph.orphans(v).collect()] == ["e0", "e3"]
    assert [tuple(r) for r in graph.retro_link(v, e).collect()] == [("e0", ["n0"], ["n1"])]


def test_links_filtered_and_ordered(spark):
    links = spark.createDataFrame([("a", "2024", "met", "Ann", "Bob", "they met"), ("b", "yesterday", "saw", "Cleo", "Dan", "Ann was there"), ("c", None, "saw", "Eve", "Fay", "x")], "id string, label string, predicate string, source_name string, target_name string, fact string")
    assert [r["id"] for r in graph.by_time_label(graph.text_filter(links, " ann ")).collect()] == ["b", "a"] and graph.text_filter(links, "").count() == 3


# ---- retrieval -------------------------------------------------------------


def test_boosts_have_their_guards(spark):
    scored = spark.createDataFrame([("a", "s", 1, 9.0, 0), ("b", "s", 2, 1.0, 1), ("c", "direct", -1, 8.0, 2), ("d", "direct", -1, 1.0, 3), ("e", "", 1, 7.0, 4), ("f", "", 1, 1.0, 5)], "id string, source_session string, source_turn int, score double, ins_seq long")
    boosts = {r["id"]: r["turn_boost"] for r in retrieval.locality(scored).collect()}
    assert boosts["b"] > 0 and boosts["a"] > 0 and all(boosts[i] == 0 for i in "cdef")
    bridge = spark.createDataFrame([("a", "p"), ("b", "p"), ("a", "o"), ("d", "o")], "event_id string, entity_id string")
    kinds = spark.createDataFrame([("p", "PERSON"), ("o", "OBJECT")], "id string, type string")
    topics = {r["id"]: r["topic_boost"] for r in retrieval.topic_boost(scored, bridge, kinds).collect()}
    assert topics["d"] == 1.8 and topics["b"] == 0


def test_matched_stems_are_those_of_the_words(spark):
    rng = random.Random(2)
    stems = ["hik", "story", "roast", "的", "北京", "我们去", "glass", "be", "ti"]
    words = ["hiking", "hikes", "Hike", "stories", "story", "roasted", "roasting", "glass", "glasses", "bees", "be", "ties", "tied", "的", "北京", "我们去", "我们去北京", "的的"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for i in range(200)] + [(999, None)]
    df = spark.createDataFrame(rows, "i long, t string")
    for r in df.select("i", "t", text.matched_stems(F.col("t"), stems).alias("m"), F.array_intersect(text.array_of(stems), text.stems_of(F.col("t"))).alias("w")).collect():
        assert sorted(r["m"] or []) == sorted(r["w"] or []), r


def test_expansion_changes_scores(spark):
    pool = spark.createDataFrame([(0, 0, ["hik"]), (1, 1, ["walk"]), (2, 2, [])], "id long, ins_seq long, stems array<string>")
    scored = {r["id"]: r for r in retrieval.keyword_scores(pool, ["hik"], ["walk", "hik"], ["walk"]).collect()}
    idf = np.log(4 / 2) + 1
    assert abs(scored[1]["expansion_bonus"] - 0.25 * idf) < 1e-9 and abs(scored[1]["descriptor_bonus"] - 0.5 * idf) < 1e-9 and scored[1]["coverage"] == 0
    assert abs(scored[0]["overlap"] - 0.5) < 1e-9 and scored[0]["expansion_bonus"] == 0


def test_engine_neighbors_and_replay(spark):
    e = entities(spark, entity(0, "Ann"), entity(1, "Bob"), entity(2, "tea", "OBJECT"))
    v = events(spark, event(0, ["n0"], ["n2"], "Ann drinks green tea"), event(1, ["n1"], ["n2"], "Bob sells leaves", mention_time=D(2026, 8, 1)), event(2, ["n1"], [], "Bob lives in Rome", mention_time=D(2026, 8, 2)))
    engine = Engine(e, v)
    near = engine.neighbors([{"id": "e0", "subject_ids": ["n0"], "object_ids": ["n2"]}], 5, 2)
    assert [(x["id"], via) for x, via in near] == [("e1", "tea"), ("e2", "Bob")]
    assert "Rome" in engine.context_block("who drinks green tea", NOW)
    ranks = engine.replay(spark.createDataFrame([("who drinks green tea", "green"), ("who drinks green tea twice", "nothing")], "question string, answer string"), NOW)
    assert {r["question"]: r["rank"] for r in ranks.collect()} == {"who drinks green tea": 1, "who drinks green tea twice": None}
    log = spark.createDataFrame([(0, "pending", "s", 1, "j", None, None, NOW), (1, "failed", "s", 1, None, None, "down", NOW)], JOB_LOG)
    told = {r["key"]: r["value"] for r in engine.status(log, {"top_k": 8}, {"embedder": False}).collect()}
    assert (told["events"], told["backlog"], told["failing"], told["last_error"], told["setting top_k"], told["model embedder"]) == ("3", "1", "1", "down", "8", "none")


def test_nearest_and_alike_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6)).round(3)
    v[7] = v[3]
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [0.0] * 6), (102, [1.0])], "id long, v array<double>")
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    c = (unit @ unit.T).round(6)
    for block in (4096, 5):
        got = {r["query_id"]: (r["near_id"], r["score"]) for r in vectors.nearest(base.where("id < 20"), base.where("id < 60"), block=block).collect()}
        np.fill_diagonal(c, -2)
        assert got == {i: (int(c[i].argmax()), c[i].max()) for i in range(20)}
    assert set(vectors.nearest(base.where("id < 20"), base, 0.95).select("query_id").toPandas()["query_id"]) == {i for i in range(20) if c[i].max() >= 0.95}
    np.fill_diagonal(c, 1)
    got = {(r["query_id"], r["near_id"]) for r in vectors.alike(base.where("id < 20"), base.where("id < 60"), 0.6).collect()}
    assert got == {(i, j) for i in range(20) for j in range(60) if c[i, j] >= 0.6}


# ---- conflicts and merges --------------------------------------------------


def facts(spark, rows):
    return spark.createDataFrame(rows, "id string, subject string, predicate string, tokens array<string>, ins_seq long, speech_act boolean, object_value string, normalized_text string, superseded_by string")


def test_predecessors_against_plain(spark):
    rng = random.Random(4)
    words = list("abcdefgh")
    rows = [(f"e{i}", rng.choice("xy"), rng.choice(["likes", "likes tea", "was liking", "owns"]), rng.sample(words, rng.randrange(6)), i, rng.random() < 0.1, rng.choice("pq"), f"t{i}", None) for i in range(120)]
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0
    want = {(n[0], o[0]) for n in rows for o in rows if n[1] == o[1] and o[4] < n[4] and not n[5] and not o[5] and (n[2] == o[2] or jac(n[3], o[3]) >= 0.8)}
    df = facts(spark, rows)
    got = [tuple(r) for r in conflict.predecessors(df, df).collect()]
    assert set(got) == want and len(got) == len(want)
    same = {(n, o) for n, o in want if rows[int(n[1:])][2] == rows[int(o[1:])][2]}
    counted = {r["new_id"]: r["n"] for r in conflict.predecessor_counts(df).collect()}
    assert counted == {n: sum(x == n for x, _ in same) for n, _ in same}


def test_detect_asks_in_calls(spark, monkeypatch):
    rows = [(f"o{i}", f"s{i}", "chairs", ["a"], i, False, "ann", f"Ann chairs {i}", None) for i in range(5)] + [(f"n{i}", f"s{i}", "chairs", ["a"], 10 + i, False, "bob", f"Bob chairs {i}", None) for i in range(5)]
    df = facts(spark, rows).coalesce(1)
    marks = conflict.detect(df.where("id LIKE 'n%'"), df, lambda groups: "\n".join(f"{i}: {'single' if '3' not in t else 'multi'}" for i, (_, t, _) in enumerate(groups, 1)))
    assert sorted(map(tuple, marks.collect())) == [(f"o{i}", f"n{i}", 10 + i) for i in (0, 1, 2, 4)]
    shown = conflict.contested_groups(df.where("id = 'n0'"), df).collect()[0]["shown"]
    assert shown == ["ann", "bob"]

    def down(groups):
        raise RuntimeError("down")

    assert conflict.detect(df.where("id LIKE 'n%'"), df, down).count() == 0


def test_find_merges(spark):
    e = entities(spark, entity(0, "Bob"), entity(1, "Bob Smith"), entity(2, "Zoe"))
    v = events(spark, event(0, ["n1"], [], "Bob Smith sings"))
    m = spark.createDataFrame([("Bob S", "PERSON", "Bob S sang"), ("Zoey", "PERSON", "Zoey ran"), ("Kim", "PERSON", "Kim")], "name string, type string, sample_fact string").coalesce(1)
    seen = []

    def sure(lines):
        out = []
        for i, (name, kind, fact, held) in enumerate(lines, 1):
            at = next((k for k, c in enumerate(held, 1) if c[0] == "Bob Smith"), None)
            assert kind == "PERSON" and fact and (at is None or held[at - 1][3] == "Bob Smith sings")
            out.append(f"{i}: {at or 1}: {'sure' if at else 'unsure'}: why")
        return "\n".join(out)

    assert [tuple(r) for r in conflict.find_merges(m, e, sure, v).collect()] == [("Bob S", "Bob Smith")]
    assert conflict.find_merges(m, e, lambda lines: 1 / 0).count() == 0 and not seen


# ---- extraction ------------------------------------------------------------


REPLY = "PERSON|Ann|Annie|likes|Green Tea|yesterday|Ann likes green tea a lot|_\nPERSON|Ann||likes|green  tea|yesterday|ann likes green tea a lot|_\nPERSON|Bobby||met|Ann|_|Bobby met Ann in 2023-05-17|_|speech\nOBJECT|x||y||_|short"


def test_ingest(spark, tmp_path):
    e = entities(spark, entity(0, "Bob"), entity(1, "ann", aliases=[]))
    v = events(spark, event(0, [], [], "we drank Green Tea", "remembered"), event(1, ["n0"], [], "bobby met ann  in 2023-05-17", "met", source_session="s", source_turn=2, time_expr="2023-05-17"))
    turns = spark.createDataFrame([("s", 1, "Ann: tea", NOW), ("s", 2, "Ann: tea", NOW)], "session_id string, turn int, turn_text string, mention_time timestamp")
    got = extraction.ingest(turns, lambda prompt: REPLY, e, v, lambda lines: "\n".join(f"{i}: 1: sure" for i, (n, *_) in enumerate(lines, 1) if n == "Bobby"), str(tmp_path))
    written = {(r["source_turn"], r["predicate"]): r for r in got.events.collect()}
    assert set(written) == {(1, "likes"), (1, "met"), (2, "likes")}  # the other was recorded before
    first = written[1, "likes"]
    assert first["subject_ids"] == ["n1"] and first["event_time"] == D(2026, 8, 31, 12) and first["event_time_precision"] == "day"
    met = written[1, "met"]
    assert met["subject_ids"] == ["n0"] and met["object_ids"] == ["n1"] and met["time_expr"] == "2023-05-17" and met["event_time"] == D(2023, 5, 17) and met["speech_act"]
    assert [(r["canonical_name"], r["type"]) for r in got.fresh.collect()] == [("Green Tea", "CONCEPT")]
    assert {r["canonical_name"]: r["aliases"] for r in got.grown.collect()} == {"ann": ["Annie"], "Bob": ["Bobby"]}
    tea = got.fresh.collect()[0]["id"]
    assert first["object_ids"] == [tea] and [tuple(r) for r in got.links.collect()] == [("e0", [tea], [])]
    counters = {r["source_turn"]: (r["entities_created"], r["entities_reused"], r["events_added"]) for r in got.counters.collect()}
    assert counters == {1: (0, 2, 2), 2: (0, 1, 1)}


def test_answer_support_sends_no_facts(spark, monkeypatch):
    """Of a fact that holds many answers only the judgement is copied to each."""
    facts = spark.createDataFrame([("Ann met Bob at noon",), ("bob alone",), (None,), ("none",)], "fact string")
    asked = spark.createDataFrame([("Ann",), ("bob",)], "answer string")
    schemas, plain = [], type(facts).mapInArrow
    monkeypatch.setattr(type(facts), "mapInArrow", lambda self, f, schema, *a, **k: schemas.append(schema) or plain(self, f, schema, *a, **k))
    got = {tuple(r) for r in evaluation.answer_support(asked, facts, ["noon"]).collect()}
    assert got == {("Ann", 1, 0), ("bob", 1, 1)} and schemas and not any("string" in s.replace("key string", "") for s in schemas)


def test_known_names_forms(spark):
    e = entities(spark, entity(0, "Ann", aliases=["Annie"]), entity(1, "tea", "OBJECT"), entity(2, "Annie", "CONCEPT"), entity(3, ""))
    texts = spark.createDataFrame([(1, "ANNIE drinks"), (2, "nothing"), (3, None)], "k long, said string")
    got = {r["k"]: r["names"] for r in extraction.known_names(e, texts, "k", "said").collect()}
    assert got == {1: "Ann (PERSON), Annie (CONCEPT)", 2: "(none relevant)", 3: "(none relevant)"}
    assert extraction.known_names(e.where("false")).collect()[0]["names"] == "(none yet)"
    assert {r["names"] for r in extraction.known_names(e.where("false"), texts, "k", "said").collect()} == {"(none yet)"}
    many = entities(spark, *[entity(i, f"name {i:04d}") for i in range(900)])
    whole = ", ".join(f"name {i:04d} (PERSON)" for i in range(900))[:4000]
    assert extraction.known_names(many).collect()[0]["names"] == whole[: whole.rindex(",")]


def test_query_model_caches_good_answers(spark):
    calls = []

    def call(query):
        calls.append(query)
        if "fail" in query:
            raise RuntimeError
        return "- hiking Trails\n• green\n\n  walk hiking" if "hike" in query else ""

    m = extraction.QueryModel(call)
    assert m.expand("Where to  hike") == ["green", "hiking", "trails", "walk"] == m.expand("where to hike") and len(calls) == 1
    assert m.expand("none") == [] == m.expand("none") and len(calls) == 3 and m.expand("fail") == []
    quoter = extraction.QueryModel(lambda q: {"long text here": " text ", "short": "longer than it"}.get(q, ""))
    assert quoter.distill("long text here") == "text" and quoter.distill("short") is None and quoter.distill("x") is None


# ---- jobs ------------------------------------------------------------------


def test_job_log_round(spark, tmp_path):
    path = str(tmp_path / "jobs")
    turns = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c"), ("s", 3, "c")], "session_id string, turn int, job string")
    none = spark.createDataFrame([], JOB_LOG)
    jobs.append_log(jobs.enqueued(turns, none), path)
    log = jobs.read_log(spark, path)
    assert jobs.counts(log).collect()[0][:] == (3, 0, 0) and jobs.enqueued(turns, log).count() == 0
    results = spark.createDataFrame([("s", 1, True, None), ("s", 2, False, "down"), ("t", 9, True, None)], "session_id string, turn int, ok boolean, error string")
    jobs.append_log(jobs.booked(log, results, "2026-09-01 12:00:00", cap=2), path)
    log = jobs.read_log(spark, path)
    assert {(r["turn"], r["failures"], r["last_error"]) for r in jobs.outstanding(log).collect()} == {(2, 1, "down"), (3, 0, None)}
    assert jobs.latest_failure(log).collect()[0]["turn"] == 2
    assert [r["turn"] for r in jobs.retryable(log, "2026-09-01 12:05:00").collect()] == [3] and jobs.retryable(log, "2026-09-01 12:10:00").count() == 2
    jobs.append_log(jobs.requeued(log, "2026-09-01 12:20:00", cap=2, failed_only=True), path)
    assert {(r["turn"], r["failures"], r["last_error"]) for r in jobs.outstanding(jobs.read_log(spark, path)).collect()} == {(2, 1, "down"), (3, 0, None)}
    again = results.where("turn = 2")
    jobs.append_log(jobs.booked(jobs.read_log(spark, path), again, "2026-09-01 13:00:00", cap=2), path)
    log = jobs.read_log(spark, path)
    assert jobs.counts(log).collect()[0][:] == (1, 0, 1) and jobs.enqueued(turns, log).count() == 2  # settled and abandoned turns are free again
    (tmp_path / "jobs" / "000000000099").mkdir()
    (tmp_path / "jobs" / "000000000099" / "x.txt").write_text('{"kind":"pending","session_id":"u","turn":1,"jo')
    assert jobs.read_log(spark, path).count() == log.count()


def test_jobs_used_up_are_abandoned(spark):
    log = spark.createDataFrame([(0, "pending", "s", 1, "j", 10, "x", NOW), (1, "pending", "s", 2, "k", 0, None, None)], JOB_LOG)
    got = {r["turn"]: (r["kind"], r["failures"], r["error"]) for r in jobs.requeued(log, "2026-09-01 12:00:00").collect()}
    assert got[1] == ("abandoned", 10, "x") and got[2][0] == "pending"


def test_waits_and_pace(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 0.999999), (4, 0.5), (9, 0.5)], "a int, r double")
    assert [round(r[0], 1) for r in df.select(jobs.next_attempt(F.col("a"), F.col("r"))).collect()] == [15.0, 48.0, 216.0, 600.0, 600.0]
    paced = jobs.paced(spark.createDataFrame([("b", 7), ("a", 3)], "j string, first_seq long"))
    assert {r["j"]: r["start_after"] for r in paced.collect()} == {"a": 0.0, "b": 3.0}


# ---- models ----------------------------------------------------------------


def test_detector_chain(spark):
    def none(t):
        return None if "Ann" in t else []

    def fails(t):
        raise RuntimeError

    def names(t):
        return [(w, "PERSON", 0.9) for w in t.split() if w[0].isupper()]

    df = spark.createDataFrame([(1, "Ann met Bob"), (2, "nobody"), (3, None)], "id long, t string")
    got = [(r["id"], r["text"], r["label"], r["score"], r["detector"]) for r in models.detect(df, "t", [fails, none, names]).orderBy("id", "text").collect()]
    assert got == [(1, "Ann", "PERSON", 0.9, 2), (1, "Bob", "PERSON", 0.9, 2)]
    assert models.detect(df, "t", [fails]).count() == 0


def test_word_pieces_and_dense_head(spark, tmp_path):
    vocabulary = {w: i for i, w in enumerate("[PAD] [UNK] [CLS] [SEP] un ##aff ##able the , 中 cafe".split())}
    assert models.word_pieces("Unaffable, the 中café xyz", vocabulary, 14) == [2, 4, 5, 6, 8, 7, 9, 10, 1, 3, 0, 0, 0, 0]
    assert models.word_pieces("the " * 50, vocabulary, 6) == [2, 7, 7, 7, 7, 3]
    df = spark.createDataFrame([([1.0, 2.0], [[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<double>, t array<array<double>>, m array<int>")
    r = df.select(models.dense(F.col("v"), [[0.1, 0.2], [1.0, -1.0]], [0.0, 0.5]).alias("d"), models.mean_pool(F.col("t"), F.col("m")).alias("p")).collect()[0]
    assert np.allclose(r["d"], np.tanh([0.5, -0.5])) and np.allclose(r["p"], np.array([2.0, 2.0]) / np.sqrt(8))
    data = np.arange(6, dtype="<f4").tobytes()
    header = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "m").write_bytes(len(header).to_bytes(8, "little") + header + data)
    assert tensors.read_tensors(str(tmp_path / "m"))["w"].tolist() == [[0, 1, 2], [3, 4, 5]]
    bad = header.replace(b"F32", b"F16")
    (tmp_path / "b").write_bytes(len(bad).to_bytes(8, "little") + bad + data)
    with pytest.raises(ValueError):
        tensors.read_tensors(str(tmp_path / "b"))


# ---- injection -------------------------------------------------------------

MESSAGES = "session_id string, turn int, step int, pos int, kind string, plugin string, claimed boolean, text string"


def test_injection(spark):
    rows = [
        ("a", 1, 1, 0, "user", None, False, "old"), ("a", 1, 1, 1, "user", None, True, " who sings? "), ("a", 1, 1, 2, "plugin", "other", True, "x"), ("a", 1, 1, 3, "assistant", None, False, "y"), ("a", 1, 2, 4, "user", None, True, "later"),
        ("b", 1, 1, 0, "user", None, True, "q" * 5000), ("c", 1, 1, 0, "user", None, True, "asked"), ("c", 1, 1, 1, "plugin", "tessera", True, "block"), ("d", 1, 1, 0, "user", None, True, "fail"), ("e", 1, 2, 0, "user", None, True, "not first"),
    ]
    m = spark.createDataFrame(rows, MESSAGES)
    assert {r["session_id"]: r["query"] for r in inject.asked(m).collect()} == {"a": "who sings?", "c": "asked", "d": "fail"}

    def block(query):
        if query == "fail":
            raise RuntimeError
        return f"about {query}"

    out = inject.inject(m, block)
    got = {s: [r["text"] for r in out.where(F.col("session_id") == s).orderBy("pos").collect()] for s in "abcde"}
    assert got["a"] == ["old", " who sings? ", "x", "about who sings?", "y", "later"]
    assert got["b"] == ["q" * 5000] and got["c"] == ["asked", "block"] and got["d"] == ["fail"] and got["e"] == ["not first"]
    assert [r["pos"] for r in out.where("session_id = 'a'").orderBy("pos").collect()] == list(range(6))


# ---- profiles, settings, audit ---------------------------------------------


def test_profile_files_and_registry(tmp_path):
    p = profiles.Profile("fast", {"route": "econ*, local/*", "extract.max_tokens": "50"}, {"extract": "Body {turn_text}\n  kept: verbatim"})
    profiles.write_profiles(str(tmp_path), [p])
    assert profiles.read_profiles(str(tmp_path)) == [p]
    with pytest.raises(ValueError):
        profiles.profile_text(profiles.Profile("x", {}, {"extract": "@@ end"}))
    builtin = {"extract": {"prompt": "default {turn_text} {known}", "max_tokens": 10, "effort": "low"}, "merge": {"prompt": "m", "max_tokens": 5, "timeout": 3}}
    told = []
    r = profiles.PromptRegistry(builtin, [p], overrides={"merge": {"prompt": "o", "effort": "high"}}, placeholders={"extract": ("{turn_text}", "{known}")}, on_resolve=lambda s, n: told.append((s, n)))
    a, b, c = r.resolve("extract", "LOCAL/x"), r.resolve("extract", "other"), r.resolve("merge")
    assert (a.prompt_from, a.profile, a.max_tokens, a.effort, a.effort_explicit) == ("profile", "fast", 50, "low", False)
    assert (b.prompt_from, b.profile, b.max_tokens) == ("builtin", "default", 10) and (c.prompt, c.prompt_from, c.effort, c.effort_explicit, c.timeout) == ("o", "override", "high", True, 3.0)
    assert r.warnings == ["fast: stage extract has no {known}"] and told == [("extract", "fast"), ("extract", "default"), ("merge", "default")]
    with pytest.raises(ValueError):
        profiles.PromptRegistry(builtin, [p], selected="none")
    with pytest.raises(ValueError):
        profiles.PromptRegistry(builtin, [p, p])


def test_effort():
    asked, told = [], []

    def able(route):
        asked.append(route)
        if route == "odd":
            raise RuntimeError
        return {"a": ["low", "high"], "b": []}.get(route)

    r = profiles.EffortResolver(able, strict=True, warn=told.append)
    assert [r.resolve("a", e) for e in ("low", "medium", "medium", "default")] == ["low", "low", "low", None] and asked == ["a"] and len(told) == 1
    assert r.resolve("b", "low") is None and r.resolve("c", "high") == "high" and r.resolve("odd", "low") == "low"
    with pytest.raises(ValueError):
        r.resolve("a", "medium", explicit=True)


def test_settings():
    known = [settings.Setting("top", "number", 8, whole=True), settings.Setting("on", "boolean", True), settings.Setting("waits", "numbers", [1, 2]), settings.Setting("name", "text")]
    bad = {"top": [-1, 1.5, "x", True, float("nan")], "on": [1, "true"], "waits": [3, [1, -1], ["a"]], "name": [1, None]}
    assert all(settings.value_error(s, v) for s in known for v in bad[s.key]) and settings.value_error(known[0], 3) is None
    file = settings.export(known, {"top": 5, "on": "no"}, {"on": False, "other": 1}, "2026-09-01")
    assert file["values"] == {"top": 5, "on": False, "waits": [1, 2]} and file["sources"] == {"top": "settings", "on": "base", "waits": "default"} and file["not_written"] == {"other": 1}
    plan = settings.plan_import(known, json.dumps(file))
    assert plan.writes == {"top": 5} and len(plan.ignored) == 2 and plan.error is None
    assert settings.plan_import(known, '{"values": {"top": 4, "x": 1}}').writes == {"top": 4}
    for raw in ("{", "[]", "{}", '{"version": 9, "values": {}}', '{"namespace": "z", "values": {}}', '{"values": {"name": "ok", "top": -1}}'):
        plan = settings.plan_import(known, raw)
        assert plan.error and not plan.writes


def test_layered_settings(spark):
    keys = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "key string, default string")
    pair = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    got = {r["key"]: (r["value"], r["source"]) for r in profiles.layered(keys, pair(("a", "9")), pair(("a", "8"), ("b", "7"))).collect()}
    assert got == {"a": ("9", "settings"), "b": ("7", "base"), "c": (None, "default")}


def test_audit_never_breaks(spark, tmp_path):
    rows = audit.audit_rows(spark.createDataFrame([("m", 1)], "mention string, n int"), "merge", "2026-09-01 12:00:00")
    assert audit.append_audit(rows, str(tmp_path / "log")) and audit.append_audit(rows, str(tmp_path / "log"))
    assert [json.loads(r["detail"]) for r in audit.read_audit(spark, str(tmp_path / "log"), "merge").collect()] == [{"mention": "m", "n": 1}] * 2
    (tmp_path / "file").write_text("x")
    assert audit.append_audit(rows, str(tmp_path / "file" / "log")) is False


# ---- evaluation ------------------------------------------------------------


def test_scored_outputs_and_summary(spark):
    said = "PERSON|Ann||likes|tea|_|Ann likes tea|_|x\nPERSON|ann||likes|tea|_|Ann likes tea|_|x\nOBJECT|42||is|x|_|我们都喜欢绿茶|_|x\nENTITY_TYPE|CANONICAL_NAME\nCONCEPT|GPT-4|gpt4o|is|_|_|_|_|_\nuser|x\nPERSON|User||is|x|_|User is x"
    rows = [("p", 1, said, "用户说我们都喜欢绿茶 with GPT-4 and gpt4o and Claude"), ("p", 2, "", "plain"), ("q", 1, "PERSON|Bob||a|b|_|Bob did it|_|x", "plain")]
    scored = evaluation.score_outputs(spark.createDataFrame(rows, "prompt string, turn int, reply string, turn_text string"), ["prompt", "turn"], ["GPT-4", "GPT4o", "Claude", "Llama"])
    got = {(r["prompt"], r["turn"]): r for r in scored.collect()}
    a = got["p", 1]
    assert (a["raw_lines"], a["pipe_lines"], a["events"], a["entities"], a["parse_fail_lines"]) == (7, 7, 5, 4, 2)
    assert (a["column_mismatch"], a["header_echo"], a["literal_rows"], a["hard_literal_rows"], a["soft_literal_rows"]) == (3, 1, 1, 1, 0)
    assert (a["speaker_rows"], a["empty_core"], a["duplicate_rows"], a["max_rows_per_entity"], a["chinese_facts"], a["collapsed_rows"], a["names_found"], a["mentioned_names"]) == (1, 1, 1, 2, 1, 1, 2, 3)
    assert a["language_match"] == 0.2 and a["name_coverage"] == 0.6667
    b = got["p", 2]
    assert b["events"] == 0 and b["language_match"] is None and b["name_coverage"] is None
    s = {r["prompt"]: r for r in evaluation.quality_summary(scored, ["prompt"]).collect()}
    assert (s["p"]["turns"], s["p"]["events"], s["p"]["events_per_turn"], s["p"]["literal_rate"], s["p"]["language_match"], s["p"]["name_coverage"]) == (2, 5, 2.5, 0.2, 0.2, 0.6667)
    assert s["q"]["name_coverage"] is None and s["q"]["literal_rate"] == 0.0


def test_small_evaluations(spark, tmp_path):
    rows = spark.createDataFrame([(["a", "b"],), (["b"],), ([],)], "c array<string>")
    assert [tuple(r) for r in evaluation.histogram(rows, "c").collect()] == [("b", 2), ("a", 1)]
    d = spark.createDataFrame([("p", "x", "x"), ("p", "x", "y"), ("p", "x", None), ("p", None, "x"), ("q", None, None)], "profile string, target string, expected string")
    assert {r["profile"]: tuple(r)[1:] for r in evaluation.wrong_merges(d).collect()} == {"p": (3, 2, 1), "q": (0, 0, 0)}
    v = events(spark, event(0, source_turn=-1), event(1, source_turn=3), event(2, source_turn=None))
    assert evaluation.query_volume(v).collect()[0][:] == (3, 1)
    evaluation.require_extracted(v)
    with pytest.raises(RuntimeError):
        evaluation.require_extracted(v.where("source_turn = -1"))
    q = spark.createDataFrame([("Current Date: x, Now Answer the Question: Who  is\nit? Answer: ",), ("Plain  Q",)], "q string")
    assert [r[0] for r in q.select(evaluation.unwrapped(F.col("q"))).collect()] == ["who is it?", "plain q"]
    corpus = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    path = str(tmp_path / "corpus")
    assert evaluation.freeze(corpus, path, "k") == 2 and evaluation.freeze(corpus.union(spark.createDataFrame([(3, "c")], "k long, t string")), path, "k") == 3
    with pytest.raises(ValueError):
        evaluation.freeze(corpus, path, "k")
    assert spark.read.json(path).count() == 3
    m = spark.createDataFrame([("f1", 0.5), ("f1", 0.7), ("query_time", 2.0)], "n string, v double")
    assert {r["n"]: r["mean"] for r in evaluation.mean_metrics(m, "n", "v").collect()} == {"f1": 60.0, "query_time": 2.0}
    folded = spark.createDataFrame([("Café  Ünï-x 中",), (None,)], "t string").select(evaluation.fold_text(F.col("t"))).collect()
    assert [r[0] for r in folded] == ["cafe uni x 中", None]
    ans = spark.createDataFrame([("1234",), ("abc",), ("abcd",)], "a string")
    assert [r[0] for r in ans.select(evaluation.verifiable(F.col("a"))).collect()] == [False, False, True]
    lit = spark.createDataFrame([("42", True), ("x.md", False), ("Ann", True)], "name string, in_subject boolean")
    assert {(r["kind"], r["side"], r["n"]) for r in evaluation.literal_audit(lit).collect()} == {("number", "subject", 1), ("filename", "object", 1)}


def test_pairing_by_question(spark):
    h = spark.createDataFrame([(0, "q2", "x"), (1, "q1", "y")], "pos long, question string, answer string")
    r = spark.createDataFrame([(0, "q1", "a"), (1, "q2", "b"), (2, "q1", "late")], "pos long, question string, answer string")
    assert {x["question"]: x["reference"] for x in evaluation.paired(h, r).collect()} == {"q1": "a", "q2": "b"}


def test_turn_quality(spark):
    rows = spark.createDataFrame([(1, 0, "Ann", "likes", "Ann likes green tea"), (1, 1, "Ann", "likes", "Ann likes green tea"), (1, 2, "v1.2", "is", "short")], "turn long, row_no int, canonical string, predicate string, fact string")
    r = evaluation.turn_quality(rows, ["turn"]).collect()[0]
    assert (r["rows"], r["short_facts"], r["literal_rows"], r["repeats"], r["max_rows_per_entity"]) == (3, 1, 1, 1, 2)


# ---- text and time ---------------------------------------------------------


def test_small_text_functions(spark):
    df = spark.createDataFrame([("Ann met Bob", ["Ann", ""], "abcdef")], "t string, n array<string>, s string")
    r = df.select(text.masked_tokens(F.col("t"), F.col("n")), text.truncate(F.col("s"), 4), text.html_safe_json(F.struct(F.lit("</x>").alias("a")))).collect()[0]
    assert r[0] == ["met", "bob"] and r[1] == "abc…" and "<" not in r[2] and json.loads(r[2]) == {"a": "</x>"}
    t = spark.createDataFrame([("", NOW, "we met on 2023-05-17"), ("yesterday", NOW, "x"), ("", NOW, "nothing")], "e string, b timestamp, f string")
    got = [(r["x"]["time"], r["x"]["precision"]) for r in t.select(timeexpr.event_time(F.col("e"), F.col("b"), F.col("f")).alias("x")).collect()]
    assert got == [(D(2023, 5, 17), "day"), (D(2026, 8, 31, 12), "day"), (None, "unknown")]


def test_parsed_entities_and_sessions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Ann", "PERSON", 0), (1, "ann", "PERSON", 1), (1, "Ann", "OBJECT", 2)], "turn long, canonical string, entity_type string, row_no int")
    assert sorted(r["row_no"] for r in extraction.parsed_entities(rows, ["turn"]).collect()) == [0, 2]
    (tmp_path / "r.json").write_text(json.dumps({"data": [{"q": "a", "n": 1}, {"q": "b", "n": 2}]}))
    assert sessions.read_results(spark, str(tmp_path / "r.json"), "q: STRING, n: INT").count() == 2
    qa = spark.createDataFrame([(["q1", "q2"], [["a"], ["b"]], "c", ("src", ["i1", "i2"], ["t1", "t2"])), (["q"], [], "c", ("src", ["i"], ["t"]))], sessions.QA)
    assert sorted((r["question"], r["question_id"]) for r in sessions.unzipped(qa, "src").collect()) == [("q1", "i1"), ("q2", "i2")]
    line = lambda seq, kind, turn=None, text_=None, source="user", plugin=None: json.dumps({"type": kind, "seq": seq, "data": {"turn": turn, "source": {"kind": source, "plugin": plugin}, "content": [{"type": "text", "text": text_}] if text_ else None}})
    lines = [line(0, "user/message", 1, "before"), line(1, "turn/start", 1), line(2, "user/message", 1, "hello"), line(3, "user/message", 1, "injected", "plugin", "x"), line(4, "user/message", 1, "ring", "plugin", "schedule"), line(5, "assistant/message", 1, "hi")]
    held = sessions.session_events(spark.createDataFrame([("p", x) for x in lines], "path string, value string")).withColumn("session_id", F.lit("s"))
    assert sessions.turn_text(held).collect()[0]["turn_text"] == "user: hello\nuser: ring\nassistant: hi"


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from tessera import __main__ as cli

    monkeypatch.setattr(cli, "_spark", lambda: spark)
    root = str(tmp_path / "g")
    journal.append(graph.records("entity.upsert", entities(spark, entity(0, "Ann"))), f"{root}/log")
    journal.append(graph.records("event.add", events(spark, event(0, ["n0"], [], "Ann sings well"))), f"{root}/log")
    assert cli.main(["doctor", root]) == 0 and json.loads(capsys.readouterr().out) == {"valid": 2, "corrupt": 0, "entities": 1, "events": 1}
    assert cli.main(["status", root]) == 0 and json.loads(capsys.readouterr().out)["events"] == "1"
    (tmp_path / "q.json").write_text('{"question": "who sings", "answer": "ann"}\n')
    assert cli.main(["replay", root, str(tmp_path / "q.json"), "--at", "2026-09-01T12:00:00"]) == 0 and json.loads(capsys.readouterr().out) == {"question": "who sings", "rank": 1}
    assert cli.main(["visualize", root, str(tmp_path / "x.html")]) == 0 and "Ann" in (tmp_path / "x.html").read_text()
    profiles.write_profiles(str(tmp_path / "p"), [profiles.Profile("fast", {"route": "a/*"}, {"s": "b"})])
    assert cli.main(["prompts", str(tmp_path / "p"), "--route", "a/b"]) == 0 and capsys.readouterr().out.strip() == '"fast"'
    (tmp_path / "s.json").write_text('[{"key": "top", "kind": "number"}]')
    (tmp_path / "f.json").write_text('{"values": {"top": -1}}')
    assert cli.main(["config", str(tmp_path / "s.json"), str(tmp_path / "f.json")]) == 1

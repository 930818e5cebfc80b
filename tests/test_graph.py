from datetime import datetime as D

from pyspark.sql import functions as F

from tessera.api import Engine
from tessera.functions import text
from tessera.operators import conflict, extraction, graph, jobs, rerank
from tessera.schema import ENTITY, EVENT
from tessera.sources import journal, profiles, sessions

NOW = D(2026, 9, 1, 12)


def event(i, subjects, objects, fact, predicate="said", mention=NOW, **more):
    row = {"id": f"e{i}", "subject_ids": subjects, "object_ids": objects, "predicate": predicate, "normalized_text": fact, "details": "", "time_expr": "", "event_time": None, "event_time_precision": "unknown", "mention_time": mention, "source_session": "s1", "source_turn": 0, "speech_act": False, "superseded_by": None, "embedding": None, "ins_seq": i}
    return tuple((row | more).values())


def entities(spark, names):
    return spark.createDataFrame([(k, n, "PERSON", [], NOW, NOW, None, i) for i, (k, n) in enumerate(names.items())], ENTITY)


def engine(spark, events):
    return Engine(entities(spark, {"a": "Ann", "b": "Bob", "t": "tea"}), spark.createDataFrame(events, EVENT))


def test_stem_and_words(spark):
    assert [text.stem_word(w) for w in ("hiking", "stories", "roasted")] == ["hik", "story", "roast"]
    df = spark.createDataFrame([("hiking",), ("stories",), ("roasted",), ("glass",)], "w string")
    assert [r[0] for r in df.select(text.stem(F.col("w"))).collect()] == [text.stem_word(w) for w in ("hiking", "stories", "roasted", "glass")]


def test_rare_word_wins(spark):
    rows = [event(0, ["a"], [], "Ann went to town"), event(1, ["a"], [], "Ann likes hiking in town"), event(2, ["a"], [], "Ann bought bread in town")]
    assert engine(spark, rows).retrieve("who likes hiking", NOW)[0]["id"] == "e1"


def test_month_filter_and_mention_anchor(spark):
    rows = [event(0, ["a"], [], "Ann sang", mention=D(2026, 8, 3), event_time=D(2026, 3, 1)), event(1, ["a"], [], "Ann sang", mention=D(2026, 6, 3), event_time=D(2026, 3, 1))]
    assert [r["id"] for r in engine(spark, rows).retrieve("what did Ann sing in June 2026", NOW)] == ["e1"]


def test_state_dedup_keeps_the_newest(spark):
    rows = [event(i, ["a"], [], f"Ann's goal is {p}", f"goal_{p}", D(2026, 8, i + 1)) for i, p in enumerate(("create", "block", "complete"))]
    assert [r["id"] for r in engine(spark, rows).retrieve("what is the goal of Ann", NOW)] == ["e2"]


def test_conflict_order_speech_and_search(spark):
    rows = [event(0, ["a"], ["t"], "Ann drinks tea", "drinks", D(2026, 7, 1)), event(1, ["a"], ["b"], "Ann drinks tea", "drinks", D(2026, 8, 1)), event(2, ["a"], [], "Ann drinks tea", "says", speech_act=True)]
    e = engine(spark, rows)
    got = [r["id"] for r in e.retrieve("Ann drinks tea", NOW)]
    assert got.index("e1") < got.index("e0")
    assert e.search("Ann drinks tea", NOW).count() >= 3
    assert e.context_block("Ann drinks tea", NOW).count("Ann drinks tea") == 1  # the others are near duplicates
    assert e.context_block("Ann drinks tea", NOW, 10) == ""


def test_remember_status_graph(spark):
    e = engine(spark, [event(0, ["a"], ["t"], "Ann drinks tea")])
    row = e.remember("Bob met Ann", NOW).collect()[0]
    assert (row["subject_ids"], row["object_ids"], row["source_turn"]) == (["a"], ["b"], -1)
    assert {r["key"]: r["value"] for r in e.status().collect()}["events"] == "1"
    nodes, links = e.graph()
    assert {r["entity_id"]: r["degree"] for r in nodes.collect()} == {"a": 1, "b": 0, "t": 1}
    assert [(r["source"], r["target"]) for r in links.collect()] == [("a", "t")]


def test_journal(spark, tmp_path):
    lines = [(0, '{"v":1,"op":"entity.upsert","data":{"id":"a","canonical_name":"Ann"}}'), (1, "{torn"), (2, '{"v":1,"op":"entity.upsert","data":{"id":"b","canonical_name":"Bob"}}'), (3, '{"v":1,"op":"entity.delete","data":{"id":"a"}}'), (4, '{"v":1,"op":"entity.upsert","data":{"id":"a","canonical_name":"Anna"}}'), (5, '{"v":1,"op":"entity.upsert","data":{"id":"b","canonical_name":"Bobby"}}')]
    records = journal.parse_lines(spark.createDataFrame(lines, "seq long, value string"))
    assert graph.corrupt_count(records).collect()[0][:] == (1, 5)
    live = {(r["id"], r["canonical_name"], r["ins_seq"]) for r in journal.live(records, "entity").collect()}
    assert live == {("a", "Anna", 4), ("b", "Bobby", 2)}
    journal.compact(records, str(tmp_path))
    journal.compact(records.where("seq < 4"), str(tmp_path))
    assert [r["id"] for r in journal.read_current(spark, str(tmp_path), "entities").collect()] == ["b"]


def test_zstd_sessions_drop_torn_tail(spark, tmp_path):
    import zstandard

    z = zstandard.ZstdCompressor()
    whole = z.compress(b'{"type":"turn/start","seq":1}\n') + z.compress(b'{"type":"turn/end","seq":2}\n')
    (tmp_path / "x.zst").write_bytes(whole + z.compress(b'{"type":"x","seq":3}\n' * 50)[:-5])
    got = sessions.session_events(sessions.read_zstd_lines(spark, str(tmp_path / "*.zst")))
    assert [r["type"] for r in got.orderBy("seq").collect()] == ["turn/start", "turn/end"]


def test_jobs(spark):
    log = [(0, "pending", "s", 1, "j", None, None, NOW), (1, "failed", "s", 1, None, None, "x", NOW), (2, "failed", "s", 1, None, None, "y", NOW), (3, "pending", "s", 2, "k", None, None, NOW), (4, "settled", "s", 2, None, None, None, NOW), (5, "pending", "t", 1, "l", 4, None, NOW), (6, "failed", "t", 1, None, None, "z", NOW)]
    df = spark.createDataFrame(log, "seq long, kind string, session_id string, turn int, job string, failures int, error string, at timestamp")
    assert [(r["job"], r["failures"], r["last_error"]) for r in jobs.outstanding(df).collect()] == [("j", 2, "y"), ("l", 5, "z")]
    assert jobs.drained(df).collect()[0][0] is False


def test_detect_conflicts(spark):
    rows = [("n", "a", "chairs", ["ann", "chairs"], 5, False, "bob", "Bob chairs", None), ("o", "a", "chairs", ["ann", "chairs"], 1, False, "ann", "Ann chairs", None), ("x", "b", "likes", ["likes"], 2, False, "tea", "tea", None)]
    events = spark.createDataFrame(rows, "id string, subject string, predicate string, tokens array<string>, ins_seq long, speech_act boolean, object_value string, normalized_text string, superseded_by string")
    new = events.where("id = 'n'")
    assert [tuple(r) for r in conflict.detect(new, events, lambda groups: "1: single").collect()] == [("o", "n", 5)]
    assert conflict.detect(new, events, lambda groups: "garbage").count() == 0
    assert conflict.parse_merge("1: 2: sure\n2: 3") == {1: (2, True), 2: (3, False)}


def test_merge_candidates(spark):
    m = spark.createDataFrame([("Bob Smith",)], "name string")
    e = spark.createDataFrame([("b", "Bob"), ("s", "Smith Jones"), ("x", "Zoe")], "id string, canonical_name string")
    assert [(r["entity_id"], r["score"]) for r in conflict.merge_candidates(m, e).orderBy("rank").collect()] == [("b", 1.0), ("s", 0.9)]


def test_resolve_or_create(spark):
    m = spark.createDataFrame([(" ann ", "PERSON", 0), ("New  Thing", "OBJECT", 1), ("new thing", "CONCEPT", 2)], "name string, type string, seq long")
    resolved, fresh = graph.resolve_or_create(m, entities(spark, {"a": "Ann"}))
    assert {r["name"]: r["created"] for r in resolved.collect()} == {" ann ": False, "New  Thing": True, "new thing": True}
    assert [(r["canonical_name"], r["type"]) for r in fresh.collect()] == [("New  Thing", "OBJECT")]


def test_segments_and_extract(spark):
    assert extraction.segments("a" * 5 + "\n" + "b" * 5, 6) == ["aaaaa", "bbbbb"]
    assert extraction.segments("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    turns = spark.createDataFrame([("s", 1, "Ann: I like green tea a lot", NOW), ("s", 2, "", NOW), ("s", 3, None, NOW)], "session_id string, turn int, turn_text string, mention_time timestamp")
    rows = extraction.extract(turns, lambda p: "CONCEPT|Ann||likes|tea|_|Ann likes green tea\nOBJECT|x||y||_|short").collect()
    assert [(r["turn"], r["entity_type"], r["canonical"]) for r in rows] == [(1, "PERSON", "Ann")]


def test_mmr_against_plain(spark):
    rows = [{"id": 0, "score": 1.0, "embedding": [1.0, 0.0]}, {"id": 1, "score": 0.99, "embedding": [1.0, 0.01]}, {"id": 2, "score": 0.5, "embedding": [0.0, 1.0]}]
    assert [r["id"] for r in rerank.mmr(rows, 2)] == [0, 2]
    left, picked = list(rows), []
    while left and len(picked) < 3:
        best = max(left, key=lambda r: r["score"] - 3 * max([0, *(rerank.cosine(r["embedding"], p["embedding"]) for p in picked)]))
        left.remove(best)
        picked.append(best)
    assert rerank.mmr(rows, 3) == picked


def test_profiles():
    p = profiles.parse_profile("x", "route: a/*\n@@ stage extract\nBody: {x}\n@@ end")
    assert (p.header, p.stages) == ({"route": "a/*"}, {"extract": "Body: {x}"})
    assert text.render("{a} {b} {c}", {"{a}": "{b}", "{b}": "2"}) == "{b} 2 {c}"

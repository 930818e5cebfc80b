import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.streaming.progress import project_batch, project_stream
from tessera.streaming.turns import completed_turns, read_events, run_jobs

ROWS = [
    ("s", 0, "todo/write", {"todos": [{"content": "a", "status": "pending"}]}),
    ("s", 1, "todo/write", {"todos": [{"content": "a", "status": "pending"}]}),
    ("s", 2, "todo/write", {"todos": [{"content": "a", "status": "completed"}]}),
    ("s", 3, "schedule/change", {"operation": "create", "schedule": {"id": 7, "kind": "every", "everySeconds": 120, "prompt": "water"}}),
    ("t", 4, "schedule/change", {"operation": "delete", "id": 7}),
    ("s", 5, "schedule/change", {"operation": "dispatch", "id": 7}),
    ("s", 6, "goal/change", {"operation": "block", "goal": {"objective": "ship", "blockedReason": {"message": "tests"}}}),
    ("s", 7, "plan/change", {"active": True}),
    ("s", 8, "goal/change", {"operation": "create"}),
    ("s", 9, "todo/write", {"todos": "x"}),
]
LINES = [(s, i, k, json.dumps(p)) for s, i, k, p in ROWS] + [("s", 10, "goal/change", "{torn")]
SCHEMA = "session_id string, ins_seq long, type string, payload string"


def test_batch_equals_stream(spark, tmp_path):
    batch = spark.createDataFrame(LINES, SCHEMA)
    want = sorted(map(tuple, project_batch(batch).collect()))
    assert [r[2] for r in sorted(want, key=lambda r: r[1])] == ["todo_update", "todo_update", "schedule_create", "schedule_delete", "schedule_dispatch", "goal_block", "plan_enter"]
    for i in range(0, len(LINES), 4):
        spark.createDataFrame(LINES[i : i + 4], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = project_stream(stream).writeStream.format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("progress").collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]


def test_completed_turns(spark, tmp_path):
    rows = [{"session_id": "s", "type": "turn/end", "seq": i, "time": "2026-09-01T12:00:00Z", "data": {"turn": 1, "reason": {"kind": k}}} for i, k in enumerate(("completed", "aborted", "completed"))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    run_jobs(completed_turns(read_events(spark, str(tmp_path / "in"))), lambda b, n: seen.extend(b.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert [(r["session_id"], r["turn"]) for r in seen] == [("s", 1)]


def test_restart_writes_once(spark, tmp_path):
    """A batch that failed is handed again; what it wrote before is not written twice."""
    rows = [{"session_id": "s", "type": "turn/end", "seq": i, "time": "2026-09-01T12:00:00Z", "data": {"turn": i, "reason": {"kind": "completed"}}} for i in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    written, calls = [], []

    def handle(batch, number):
        calls.append(number)
        facts = batch.select(F.col("session_id").alias("source_session"), F.col("turn").alias("source_turn"), F.lit("said").alias("predicate"), F.concat(F.lit("fact "), F.col("turn")).alias("normalized_text"), F.lit("").alias("time_expr"))
        known = spark.createDataFrame(written, facts.schema)
        fresh = [tuple(r) for r in graph.new_only(facts, known).collect()]
        written.extend(fresh[:2] if len(calls) == 1 else fresh)
        if len(calls) == 1:
            raise RuntimeError("the worker was lost")

    first = run_jobs(completed_turns(read_events(spark, str(tmp_path / "in"))), handle, str(tmp_path / "c"))
    with pytest.raises(Exception, match="lost"):
        first.awaitTermination(120)
    run_jobs(completed_turns(read_events(spark, str(tmp_path / "in"))), handle, str(tmp_path / "c")).awaitTermination(120)
    assert calls == [0, 0] and sorted(r[1] for r in written) == [0, 1, 2]


def test_late_turns_are_taken_as_they_arrive(spark, tmp_path):
    seen = []
    for day, at in ((3, "a"), (1, "b")):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{at}.json").write_text(json.dumps({"session_id": "s", "type": "turn/end", "seq": day, "time": f"2026-09-0{day}T12:00:00Z", "data": {"turn": day, "reason": {"kind": "completed"}}}))
        run_jobs(completed_turns(read_events(spark, str(folder))), lambda b, n: seen.extend(b.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert [r["turn"] for r in seen] == [3, 1] and seen[1]["mention_time"].day == 1

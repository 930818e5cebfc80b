"""Progress events projected to state events, in batch or as a stream.

The batch form uses windows; the stream form keeps, per session, the last to-do
signature and the prompts of schedules.  Both skip what they can't read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, ins_seq long, predicate string, entity_name string, text string"
STATE = "signature string, prompts string"

# Wording of the projected events.
GOAL_TEXT = {"create": "创建了目标「{}」。", "complete": "目标「{}」已完成。", "pause": "目标「{}」已暂停。", "resume": "目标「{}」已恢复进行。"}


def cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 1] + "…"


def goal(data: dict) -> tuple[str, str, str] | None:
    op = data.get("operation") or "update"
    if op == "clear":
        return "goal_clear", "agent 目标", "当前目标已被清除（clear）。"
    held = data.get("goal") or data
    aim = held.get("objective")
    if not isinstance(aim, str) or not aim:
        return None
    name, short = f"目标：{cut(aim, 20)}", cut(aim, 40)
    if op in GOAL_TEXT:
        return f"goal_{op}", name, GOAL_TEXT[op].format(short)
    if op == "block":
        reason = (held.get("blockedReason") or {}).get("message")
        return "goal_block", name, f"目标「{short}」被阻塞{'：' + cut(reason, 80) if isinstance(reason, str) else ''}。"
    return "goal_update", name, f"目标「{short}」状态更新为 {held.get('phase') or op}。"


# The sentences made in todo() and schedule() below.
def todo(items: Any) -> tuple[str, str] | None:
    """(signature, text) of a whole list."""
    if not isinstance(items, list) or not all(isinstance(t, dict) for t in items):
        return None
    rows = [(str(t.get("status") or "pending"), str(t.get("content") or "")) for t in items]
    by = {s: [cut(c, 30) for k, c in rows if k == s] for s in ("completed", "in_progress", "pending")}
    parts = [f"待办列表更新：{len(by['completed'])}/{len(rows)} 项已完成"]
    parts += [f"{label}：{'；'.join(by[s])}" for s, label in (("in_progress", "进行中"), ("pending", "待处理")) if by[s]]
    if rows and len(by["completed"]) == len(rows):
        parts.append("全部完成")
    return "|".join(f"{s}:{c}" for s, c in rows), "。".join(parts) + "。"


def schedule(data: dict, prompts: dict[str, str]) -> tuple[str, str, str] | None:
    op = data.get("operation")
    if op == "create":
        held = data.get("schedule") or {}
        if held.get("id") is None or not isinstance(held.get("prompt"), str):
            return None
        prompts[str(held["id"])] = held["prompt"]
        every = held.get("kind") == "every"
        how = f"每 {int((held.get('everySeconds') or 0) / 60 + 0.5)} 分钟" if every else f"一次性（{held.get('scheduledAt') or '?'}）"
        return "schedule_create", f"提醒：{cut(held['prompt'], 20)}", f"创建了定时提醒「{cut(held['prompt'], 50)}」（{how}）。"
    if op not in ("delete", "dispatch") or data.get("id") is None:
        return None
    prompt = prompts.get(str(data["id"]))
    what = f"「{cut(prompt, 50)}」" if prompt is not None else f"（id: {data['id']}）"
    text = f"删除了定时提醒{what}。" if op == "delete" else f"定时提醒已触发{what}。"
    return f"schedule_{op}", f"提醒：{cut(prompt, 20)}" if prompt is not None else "定时提醒", text


def project(rows: list[tuple], state: tuple[str | None, dict]) -> tuple[list[tuple], tuple[str | None, dict]]:
    """rows (session_id, ins_seq, type, payload) of one session, in order."""
    signature, prompts = state
    out = []
    for session, seq, kind, payload in rows:
        try:
            data = json.loads(payload)
            if not isinstance(data, dict):
                continue
            if kind == "todo/write":
                found = todo(data.get("todos"))
                if found is None or found[0] == signature:
                    continue
                signature = found[0]
                event = ("todo_update", "待办列表", found[1])
            elif kind == "goal/change":
                event = goal(data)
            elif kind == "schedule/change":
                event = schedule(data, prompts)
            elif kind == "plan/change" and isinstance(data.get("active"), bool):
                event = ("plan_enter", "计划模式", "进入计划模式。") if data["active"] else ("plan_exit", "计划模式", "退出计划模式。")
            else:
                continue
        except (ValueError, TypeError, AttributeError):  # malformed input never ends the stream
            continue
        if event:
            out.append((session, seq, *event))
    return out, (signature, prompts)


def changed(rows: DataFrame, key: str, order: list[str], signature: str) -> DataFrame:
    """Rows of each key whose signature is another than the one before, null included."""
    before = F.lag(signature).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return rows.withColumns({"_before": before, "_first": first}).where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(signature))).drop("_before", "_first")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session_id", "ins_seq", "predicate", "entity_name", "text"])


def project_batch(events: DataFrame) -> DataFrame:
    """events (session_id, ins_seq, type, payload) -> state events."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("ins_seq")
        return _frame(project(list(ordered[["session_id", "ins_seq", "type", "payload"]].itertuples(index=False, name=None)), (None, {}))[0])

    return events.groupBy("session_id").applyInPandas(one, OUT)


def project_stream(events: DataFrame) -> DataFrame:
    """The same over a stream; state per session, no timeout: late rows are taken as they arrive."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, "{}")
        now = (held[0], json.loads(held[1]))
        rows = [r for f in frames for r in f[["session_id", "ins_seq", "type", "payload"]].itertuples(index=False, name=None)]
        out, now = project(sorted(rows, key=lambda r: r[1]), now)
        state.update((now[0], json.dumps(now[1])))
        yield _frame(out)

    return events.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

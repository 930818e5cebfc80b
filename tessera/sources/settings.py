"""Settings: validated values, layered export, and imports that are checked whole before
anything is written."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any

VERSION, NAMESPACE = 1, "tessera"


@dataclass(frozen=True)
class Setting:
    """kind: text, number, boolean or numbers; whole: only whole numbers."""

    key: str
    kind: str
    default: Any = None
    whole: bool = False


@dataclass
class ImportPlan:
    """What an import would write; with an error nothing may be written."""

    writes: dict[str, Any] = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)
    error: str | None = None


def _number(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)


def value_error(setting: Setting, value: Any) -> str | None:
    """Why the setting can't take the value; None: it can."""
    shown = json.dumps(value, ensure_ascii=False, default=str)
    if setting.kind == "text":
        return None if isinstance(value, str) else f"a text is needed, not {shown}"
    if setting.kind == "boolean":
        return None if isinstance(value, bool) else f"true or false is needed, not {shown}"
    if setting.kind == "numbers":
        if not isinstance(value, list):
            return f"a list of numbers is needed, not {shown}"
        bad = next((x for x in value if not _number(x) or x < 0), None)
        return None if bad is None else f"not a number from 0 on in the list: {json.dumps(bad, default=str)}"
    if not _number(value):
        return f"a number is needed, not {shown}"
    if value < 0:
        return "a number from 0 on is needed"
    return "a whole number is needed" if setting.whole and value != int(value) else None


def owned(settings: list[Setting], layer: Any) -> dict[str, Any]:
    """The layer's values of known settings that they can take."""
    layer = layer if isinstance(layer, dict) else {}
    return {s.key: layer[s.key] for s in settings if layer.get(s.key) is not None and value_error(s, layer[s.key]) is None}


def export(settings: list[Setting], user: Any, base: Any, exported_at: str) -> dict:
    """Values in force (user over base over default) and where each is from; keys of the
    base that are no settings are listed, and those without a value left out."""
    mine, theirs = owned(settings, user), owned(settings, base)
    values, sources = {}, {}
    for s in settings:
        for name, layer in (("settings", mine), ("base", theirs), ("default", {s.key: s.default})):
            if layer.get(s.key) is not None:
                values[s.key], sources[s.key] = layer[s.key], name
                break
    known = {s.key for s in settings}
    rest = {k: v for k, v in (base if isinstance(base, dict) else {}).items() if k not in known}
    return {"version": VERSION, "namespace": NAMESPACE, "exported_at": exported_at, "values": values, "sources": sources, "not_written": rest}


def plan_import(settings: list[Setting], raw: str) -> ImportPlan:
    """Read an export or a hand-written file.  Of an export only the values whose source
    are the settings are written back, so that inherited ones don't become overrides;
    one bad value refuses the whole file."""
    plan = ImportPlan()
    try:
        file = json.loads(raw)
    except ValueError as e:
        return ImportPlan(error=f"not JSON: {e}")
    if not isinstance(file, dict):
        return ImportPlan(error="not an object")
    if file.get("namespace", NAMESPACE) != NAMESPACE:
        return ImportPlan(error=f"of another namespace: {file['namespace']}")
    if file.get("version", VERSION) != VERSION:
        return ImportPlan(error=f"of an unknown version: {file['version']}")
    if not isinstance(file.get("values"), dict):
        return ImportPlan(error="without values")
    sources = file.get("sources") if isinstance(file.get("sources"), dict) else {}
    by = {s.key: s for s in settings}
    for key, value in file["values"].items():
        if key not in by:
            plan.ignored.append(f"{key}: unknown")
        elif sources.get(key, "settings") != "settings":
            plan.ignored.append(f"{key}: from {sources[key]}")
        elif why := value_error(by[key], value):
            return ImportPlan(ignored=plan.ignored, error=f"{key}: {why}")
        else:
            plan.writes[key] = value
    return plan

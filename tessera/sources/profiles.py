"""Prompt profiles: `key: value` headers and verbatim `@@ stage` blocks, and the
first profile whose route globs fit."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_pattern


@dataclass
class Profile:
    name: str
    header: dict[str, str] = field(default_factory=dict)
    stages: dict[str, str] = field(default_factory=dict)


def parse_profile(name: str, text: str) -> Profile:
    out, stage, body = Profile(name), None, []
    for number, line in enumerate(text.split("\n"), 1):
        opened = re.match(r"^@@\s*stage\s+(\S+)\s*$", line)
        if stage is not None:
            if re.match(r"^@@\s*end\s*$", line):
                out.stages[stage] = "\n".join(body)
                stage, body = None, []
            elif opened:
                raise ValueError(f"{name}:{number}: stage {stage} isn't closed")
            else:
                body.append(line)
        elif opened:
            if opened[1] in out.stages:
                raise ValueError(f"{name}:{number}: stage {opened[1]} twice")
            stage = opened[1]
        elif line.strip() and not line.startswith("#"):
            key, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"{name}:{number}: expected `key: value`")
            out.header[key.strip()] = value.strip()
    if stage is not None:
        raise ValueError(f"{name}: stage {stage} isn't closed")
    return out


def read_profiles(folder: str) -> list[Profile]:
    return [parse_profile(p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.prompts"))]


def profile_text(profile: Profile) -> str:
    """The file of a profile, such that parse_profile reads it back."""
    for name, body in profile.stages.items():
        if any(re.match(r"^@@\s*(end|stage\s+\S+)\s*$", x) for x in body.split("\n")):
            raise ValueError(f"{profile.name}: a line of stage {name} reads as a mark")
    lines = [f"{k}: {v}" for k, v in profile.header.items()]
    for name, body in profile.stages.items():
        lines += ["", f"@@ stage {name}", body, "@@ end"]
    return "\n".join(lines) + "\n"


def write_profiles(folder: str, profiles: list[Profile]) -> None:
    """One file a profile; each is replaced whole."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for p in profiles:
        text, to = profile_text(p), Path(folder, f"{p.name}.prompts")
        fresh = to.with_suffix(".new")
        fresh.write_text(text, encoding="utf-8")
        fresh.replace(to)


@dataclass(frozen=True)
class Resolved:
    """What a stage is called with, and where each part is from."""

    stage: str
    prompt: str
    max_tokens: int
    timeout: float | None
    effort: str
    effort_explicit: bool
    profile: str
    prompt_from: str


class PromptRegistry:
    """Prompt and budget per stage and route: an override before the profile's, before
    the built-in.  A profile is the selected one, else the first whose `route` globs
    (comma-separated) fit, else the default.  Faults are found when it is made."""

    DEFAULT = "default"

    def __init__(self, builtin: dict[str, dict], profiles: list[Profile] = (), selected: str | None = None, overrides: dict[str, dict] | None = None, placeholders: dict[str, tuple[str, ...]] | None = None, on_resolve: Callable[[str, str], None] | None = None):
        names = [self.DEFAULT, *(p.name for p in profiles)]
        if len(set(names)) < len(names):
            raise ValueError("two profiles of one name")
        if selected is not None and selected not in names:
            raise ValueError(f"no profile {selected!r}; known: {', '.join(names)}")
        unknown = {s for p in profiles for s in p.stages} - set(builtin) | set(overrides or {}) - set(builtin)
        if unknown:
            raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
        self.builtin, self.profiles, self.selected, self.overrides = builtin, list(profiles), selected, overrides or {}
        self.on_resolve, self.reported = on_resolve, {}
        #: Prompts that drop a placeholder of their stage.
        self.warnings = [f"{p.name}: stage {stage} has no {mark}" for p in profiles for stage, body in p.stages.items() for mark in (placeholders or {}).get(stage, ()) if mark not in body]

    def names(self) -> list[str]:
        return [self.DEFAULT, *(p.name for p in self.profiles)]

    def profile_for(self, route: str | None = None) -> Profile:
        if self.selected is not None:
            return next((p for p in self.profiles if p.name == self.selected), Profile(self.DEFAULT))
        for p in self.profiles if route is not None else ():
            globs = [g.strip() for g in p.header.get("route", "").split(",") if g.strip()]
            if any(re.match(glob_pattern(g), route) for g in globs):
                return p
        return Profile(self.DEFAULT)

    def resolve(self, stage: str, route: str | None = None) -> Resolved:
        profile, base, over = self.profile_for(route), self.builtin[stage], self.overrides.get(stage, {})
        mine = {k.partition(".")[2]: v for k, v in profile.header.items() if k.startswith(f"{stage}.")}
        if stage in profile.stages:
            mine["prompt"] = profile.stages[stage]
        if self.reported.get(stage) != profile.name:
            self.reported[stage] = profile.name
            if self.on_resolve:
                self.on_resolve(stage, profile.name)

        def first(name: str):
            return next((layer[name] for layer in (over, mine, base) if layer.get(name) is not None), None)

        source = "override" if over.get("prompt") is not None else "profile" if "prompt" in mine else "builtin"
        explicit = over.get("effort") is not None or "effort" in mine
        timeout = first("timeout")
        return Resolved(stage, first("prompt"), int(first("max_tokens")), None if timeout is None else float(timeout), first("effort") or "default", explicit, profile.name, source)


class EffortResolver:
    """The reasoning effort a route is asked for.  What a route can do is learned once
    and kept; an effort that it lacks becomes the nearest lower one (adapt), or an error
    if it was chosen explicitly and strict is on.  Each change is told once a route."""

    ORDER = ("none", "minimal", "low", "medium", "high")

    def __init__(self, capability: Callable[[str], list[str] | None], strict: bool = False, warn: Callable[[str], None] | None = None):
        self.capability, self.strict, self.warn = capability, strict, warn
        self.known: dict[str, list[str] | None] = {}
        self.told: set[tuple[str, str]] = set()

    def resolve(self, route: str, effort: str, explicit: bool = False) -> str | None:
        """The effort to ask for; None: say nothing of it to this route."""
        if route not in self.known:
            try:
                self.known[route] = self.capability(route)
            except Exception:  # a route that can't tell is asked as it is
                return effort
        able = self.known[route]
        if able is None or effort == "default":
            return None if effort == "default" else effort
        if effort in able:
            return effort
        if explicit and self.strict:
            raise ValueError(f"{route} can't do effort {effort!r}; it can: {', '.join(able) or 'none'}")
        at = self.ORDER.index(effort) if effort in self.ORDER else len(self.ORDER) - 1
        lower = [e for e in self.ORDER[: at + 1] if e in able]
        chosen = lower[-1] if lower else None
        if self.warn and (route, effort) not in self.told:
            self.told.add((route, effort))
            self.warn(f"{route}: effort {effort} becomes {chosen or 'unset'}")
        return chosen


def select_profile(routes: DataFrame, profiles: list[tuple[str, str]], route: str = "route") -> DataFrame:
    """routes with profile: the first (name, glob) in order that fits, else default.
    The list is configuration, so it is literals of the plan."""
    chosen = F.lit("default")
    for name, glob in reversed(profiles):
        chosen = F.when(F.col(route).rlike(glob_pattern(glob)), name).otherwise(chosen)
    return routes.withColumn("profile", chosen)


def layered(keys: DataFrame, settings: DataFrame, base: DataFrame) -> DataFrame:
    """(key, value, source) of a configuration: settings over base over default."""
    joined = keys.join(settings.select("key", F.col("value").alias("_s")), "key", "left").join(base.select("key", F.col("value").alias("_b")), "key", "left")
    source = F.when(F.col("_s").isNotNull(), "settings").when(F.col("_b").isNotNull(), "base").otherwise("default")
    return joined.select("key", F.coalesce("_s", "_b", "default").alias("value"), source.alias("source"))


def as_of(log: DataFrame, key: str, order: list[str], is_source: str, value: str) -> DataFrame:
    """The last value of a source row at or before each row: an as-of join in one window."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("as_of", F.last(F.when(F.expr(is_source), F.col(value)), ignorenulls=True).over(before))

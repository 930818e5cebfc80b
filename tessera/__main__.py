"""python -m tessera doctor | status | replay | visualize | prompts | config ...: thin
wrappers around the library, each over a graph's folder or a settings file."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime
from pathlib import Path


def _spark():
    from .session import get_spark, share_package

    spark = get_spark()
    share_package(spark)
    return spark


def _graph(spark, root: str):
    from .sources import journal

    records = journal.read_journal(spark, f"{root}/log")
    return journal.live(records, "entity"), journal.live(records, "event"), records


def doctor(args) -> int:
    """Whether a graph's journal can be read: records, corrupt lines, live rows."""
    from .operators.graph import corrupt_count

    entities, events, records = _graph(_spark(), args.root)
    row = corrupt_count(records).head()
    print(json.dumps({"valid": row["valid"], "corrupt": row["corrupt"], "entities": entities.count(), "events": events.count()}))
    return int(row["corrupt"] > 0)


def status(args) -> int:
    from .api import Engine

    entities, events, _ = _graph(_spark(), args.root)
    print(json.dumps({r["key"]: r["value"] for r in Engine(entities, events).status().collect()}))
    return 0


def replay(args) -> int:
    """Ranks of the answers of a JSON-lines file of question and answer."""
    from .api import Engine

    spark = _spark()
    entities, events, _ = _graph(spark, args.root)
    questions = spark.read.schema("question string, answer string").json(args.questions)
    for r in Engine(entities, events).replay(questions, datetime.fromisoformat(args.at), args.top).collect():
        print(json.dumps({"question": r["question"], "rank": r["rank"]}, ensure_ascii=False))
    return 0


def visualize(args) -> int:
    from .api import Engine
    from .sources.html import page

    entities, events, _ = _graph(_spark(), args.root)
    Path(args.out).write_text(page(*Engine(entities, events).graph()), encoding="utf-8")
    return 0


def prompts(args) -> int:
    """The profiles of a folder, or the one that fits a route."""
    from .sources.profiles import PromptRegistry, read_profiles

    profiles = read_profiles(args.folder)
    registry = PromptRegistry({s: {"prompt": "", "max_tokens": 0} for p in profiles for s in p.stages}, profiles)
    print(json.dumps(registry.names() if args.route is None else registry.profile_for(args.route).name))
    return 0


def config(args) -> int:
    """What an import of a settings file would write, by a list of settings."""
    from .sources.settings import Setting, plan_import

    settings = [Setting(**s) for s in json.loads(Path(args.settings).read_text())]
    plan = plan_import(settings, Path(args.file).read_text())
    print(json.dumps({"writes": plan.writes, "ignored": plan.ignored, "error": plan.error}, ensure_ascii=False))
    return int(plan.error is not None)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for f, names in ((doctor, ["root"]), (status, ["root"]), (visualize, ["root", "out"]), (config, ["settings", "file"])):
        p = commands.add_parser(f.__name__)
        for n in names:
            p.add_argument(n)
        p.set_defaults(run=f)
    p = commands.add_parser("replay")
    p.add_argument("root")
    p.add_argument("questions")
    p.add_argument("--at", default=datetime.now().isoformat())
    p.add_argument("--top", type=int, default=10)
    p.set_defaults(run=replay)
    p = commands.add_parser("prompts")
    p.add_argument("folder")
    p.add_argument("--route")
    p.set_defaults(run=prompts)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())

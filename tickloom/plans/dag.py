"""Stages with dependencies: run all, from, through or only one; a stage whose evidence still holds is skipped."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter


@dataclass
class Stage:
    name: str
    run: Callable[[], dict]
    after: list[str] = field(default_factory=list)
    fresh: Callable[[], bool] | None = None


class Dag:
    def __init__(self, stages: list[Stage]):
        self.stages = {s.name: s for s in stages}
        unknown = {d for s in stages for d in s.after} - set(self.stages)
        if unknown or len(self.stages) != len(stages):
            raise ValueError(f"unknown or repeated stages: {sorted(unknown) or 'repeated names'}")
        self.order = list(TopologicalSorter({s.name: s.after for s in stages}).static_order())

    def plan(self, start: str | None = None, through: str | None = None, only: str | None = None) -> list[str]:
        if only:
            return [only]
        lo = self.order.index(start) if start else 0
        hi = self.order.index(through) + 1 if through else len(self.order)
        return self.order[lo:hi]

    def execute(self, **which) -> list[dict]:
        """Runs the planned stages; a stage that fails stops those behind it and is reported."""
        out = []
        for name in self.plan(**which):
            stage = self.stages[name]
            if stage.fresh and stage.fresh():
                out.append({"stage": name, "action": "skipped"})
                continue
            try:
                out.append({"stage": name, "action": "ran", **stage.run()})
            except Exception as e:  # reported with its stage, then raised
                e.add_note(json.dumps({"stage": name, "done": out}))
                raise
        return out


def main(argv: list[str] | None = None) -> None:
    """List queries, or run one over a folder of tables and write its result as Parquet."""
    parser = argparse.ArgumentParser(prog="tickloom", description=main.__doc__)
    parser.add_argument("query", nargs="?")
    parser.add_argument("--tables", help="folder of <name>.parquet tables")
    parser.add_argument("--out", help="result folder; else the first rows are shown")
    args = parser.parse_args(argv)
    from ..session import build_session
    from .catalogue import QUERIES

    if not args.query:
        print("\n".join(sorted(QUERIES)))
        return
    df = QUERIES[args.query](build_session(), args.tables)
    df.write.parquet(args.out) if args.out else df.show(20, truncate=False)

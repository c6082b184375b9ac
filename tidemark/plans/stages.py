"""The pipeline of stages as data: what runs, in which order, and what is left out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...] = ()
    heavy: bool = False
    run: Callable | None = field(default=None, compare=False)


#: The stages in order.
STAGES = (
    Stage("data"),
    Stage("synthetic", heavy=True),
    Stage("detect", ("data",)),
    Stage("forecast", ("data",), heavy=True),
    Stage("adapt", ("detect", "forecast"), heavy=True),
    Stage("uncertainty", ("adapt",), heavy=True),
    Stage("escalation", ("uncertainty",)),
    Stage("produce", ("escalation",)),
)


def select(stages: Sequence[Stage], named: Sequence[str] = (), include_heavy: bool = False) -> tuple[list[Stage], list[Stage]]:
    """(to run, left out), both in pipeline order: what is named, or all but the heavy ones; unknown names are an error."""
    unknown = set(named) - {s.name for s in stages}
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    chosen = [s for s in stages if s.name in named or not named and (include_heavy or not s.heavy)]
    return chosen, [s for s in stages if s not in chosen]


def execute(stages: Sequence[Stage], dry_run: bool = False, keep_going: bool = False) -> list[tuple[str, str]]:
    """(name, outcome) of each stage; stops at the first failure unless told to keep going, and skips what needs a failed stage."""
    log, failed = [], set()
    for s in stages:
        if dry_run or s.run is None:
            log.append((s.name, "planned"))
        elif failed & set(s.needs) or failed and not keep_going:
            failed.add(s.name)
            log.append((s.name, "skipped"))
        else:
            try:
                s.run()
                log.append((s.name, "done"))
            except Exception as e:  # the outcome is what is logged
                failed.add(s.name)
                log.append((s.name, f"failed: {e}"))
    return log

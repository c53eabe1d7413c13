"""Named stages over data frames, run whole or in part."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    args: dict = field(default_factory=dict)


def select_stages(stages: list[Stage], only: list[str] | None = None, first: str | None = None, last: str | None = None) -> list[Stage]:
    """The stages named by `only`, or those from `first` to `last`; unknown names fail."""
    names = [s.name for s in stages]
    for name in [*(only or []), *[n for n in (first, last) if n]]:
        if name not in names:
            raise ValueError(f"no stage {name}; there are {', '.join(names)}")
    if only:
        return [s for s in stages if s.name in only]
    return stages[names.index(first) if first else 0 : names.index(last) + 1 if last else len(stages)]


def run_stages(stages: list[Stage], sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Results by stage name; a stage reads sources and earlier results. Nothing runs until a result is used."""
    found = dict(sources)
    for stage in stages:
        missing = [n for n in stage.inputs if n not in found]
        if missing:
            raise ValueError(f"stage {stage.name} lacks {', '.join(missing)}")
        found[stage.name] = stage.run(*[found[n] for n in stage.inputs], **stage.args)
    return found

"""The steps from export to comparison as a list, run in order or only shown."""

from __future__ import annotations

import platform
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

MODELS = ("yolo", "faster_rcnn", "rtdetr")


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[], object] | None = None  # None: left to another system, as training is


def plan(models: Sequence[str] = MODELS, convert: bool = True, train: bool = True, predict: bool = True, actions: dict[str, Callable[[], object]] | None = None) -> list[Step]:
    """convert, then of each model train, predict and evaluate, then compare. Names of models in any case."""
    chosen = [m.lower() for m in models]
    unknown = [m for m in chosen if m not in MODELS]
    if unknown:
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    names = ["convert"] * convert
    for m in chosen:
        names += [f"{m}:train"] * train + [f"{m}:predict"] * predict + [f"{m}:evaluate"]
    names.append("compare")
    return [Step(n, (actions or {}).get(n)) for n in names]


def execute(steps: Sequence[Step], dry_run: bool = False) -> list[str]:
    """Runs the steps one after the other; a failure ends it. With dry_run the names only."""
    for s in steps:
        if not dry_run and s.run is not None:
            s.run()
    return [s.name for s in steps]


def environment() -> dict[str, str]:
    """Versions of what this runs on; missing parts are named as such."""
    out = {"python": sys.version.split()[0], "platform": platform.platform()}
    for m in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            out[m] = __import__(m).__version__
        except ImportError:
            out[m] = "missing"
    return out

"""Named operators: functions from DataFrames to a DataFrame, by kind, found again by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

KINDS = ("model", "dataset", "trainer", "metric")
_KNOWN: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Register a function under a kind and a name; a name taken is an error."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")

    def add(f: Callable) -> Callable:
        if (kind, name) in _KNOWN:
            raise ValueError(f"{kind} {name} is registered")
        _KNOWN[kind, name] = f
        return f

    return add


def find(kind: str, name: str) -> Callable:
    return _KNOWN[kind, name]


def chain(df: DataFrame, steps: list[Callable], **options) -> DataFrame:
    """Apply steps in turn; each gets those options that its signature names."""
    for step in steps:
        names = inspect.signature(step).parameters
        df = step(df, **{k: v for k, v in options.items() if k in names})
    return df

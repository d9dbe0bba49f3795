"""Named readers: every source registers a function that returns its records as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def register(name: str) -> Callable[[Reader], Reader]:
    """Decorator; a name can be registered once."""

    def add(reader: Reader) -> Reader:
        if name in _READERS:
            raise ValueError(f"reader {name} is registered already")
        _READERS[name] = reader
        return reader

    return add


def reader(name: str) -> Reader:
    if name not in _READERS:
        raise KeyError(f"no reader {name}; known are {', '.join(sorted(_READERS))}")
    return _READERS[name]


def readers() -> list[str]:
    return sorted(_READERS)

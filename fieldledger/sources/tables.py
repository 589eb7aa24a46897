"""A mapping from table name to DataFrame that opens a table when it is first asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class Tables(Mapping[str, DataFrame]):
    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]):
        self._openers = dict(openers)
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self._openers[name]()
        return self._open[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)

    def replace(self, **frames: DataFrame) -> Tables:
        """The same tables with some of them exchanged, e.g. for a new version."""
        changed = Tables(self._openers)
        changed._open = dict(self._open)
        for name, frame in frames.items():
            changed._openers[name] = lambda frame=frame: frame
            changed._open[name] = frame
        return changed

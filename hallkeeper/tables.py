"""A thin, immutable mapping of table names to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class Tables(Mapping):
    """Tables by name; entries may be DataFrames or zero-argument loaders.

    A loader runs the first time its table is read, so a query only pays for
    the tables it uses. ``t.room`` and ``t["room"]`` are the same thing.
    """

    def __init__(self, entries: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._entries = dict(entries)

    def __getitem__(self, name: str) -> DataFrame:
        entry = self._entries[name]
        if not isinstance(entry, DataFrame):
            entry = entry()
            self._entries[name] = entry
        return entry

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise AttributeError(f"no table named {name!r}") from None

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)

    def replacing(self, **tables: DataFrame) -> Tables:
        """A copy with some tables replaced or added."""
        return Tables({**self._entries, **tables})

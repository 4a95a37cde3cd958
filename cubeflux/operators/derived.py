"""Derived tables that are worked out only for who asks for them, and again only after what they come from has changed.

A table is defined by the names it needs and a function of them. Nobody's table is computed; a subscribed one is kept, read
by all who subscribed, and dropped when a source it depends on is set or its last subscriber leaves. Spark plans the rest:
the functions give DataFrames, which are lazy themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Representations of a cube by their short names, and what users call them: fixed values.
REPRESENTATIONS = {"IMG": "Original Image", "NORM": "Normalized Image", "GRAD": "Spectral Gradient", "IMGPCA": "Image PCA", "GRADPCA": "Spectral Gradient PCA"}
NONE = "None"


def representation(name: str) -> str | None:
    """The short name if it is one."""
    return name if name in REPRESENTATIONS else None


def title(name: str | None) -> str:
    return REPRESENTATIONS.get(name or "", NONE)


class Derived:
    def __init__(self):
        self.needs: dict[str, tuple[str, ...]] = {}
        self.make: dict[str, Callable[..., DataFrame]] = {}
        self.sources: dict[str, DataFrame] = {}
        self.kept: dict[str, DataFrame] = {}
        self.readers: Counter[str] = Counter()
        #: How often each table was made.
        self.made: Counter[str] = Counter()

    def define(self, name: str, needs: tuple[str, ...], make: Callable[..., DataFrame]) -> None:
        if name in self._before(needs):
            raise ValueError(f"{name} would need itself")
        self.needs[name], self.make[name] = needs, make
        self._forget(name)

    def _before(self, names) -> set[str]:
        """names and all they come from."""
        seen, todo = set(), list(names)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += self.needs.get(n, ())
        return seen

    def _forget(self, name: str) -> None:
        """Drop what comes from a table, and itself."""
        for n in [n for n in self.kept if name in self._before([n])]:
            self.kept.pop(n).unpersist()

    def set(self, name: str, table: DataFrame) -> None:
        """A source's new content: who depends on it is out of date."""
        self.sources[name] = table
        self._forget(name)

    def subscribe(self, name: str) -> None:
        if name not in self.make and name not in self.sources:
            raise KeyError(name)
        self.readers[name] += 1

    def unsubscribe(self, name: str) -> None:
        self.readers[name] -= 1
        if self.readers[name] <= 0:
            del self.readers[name]
            if name in self.kept:
                self.kept.pop(name).unpersist()

    def get(self, name: str) -> DataFrame:
        """A subscribed table, made if it isn't there. What it needs is kept too if it is subscribed, else only planned."""
        if not self.readers[name]:
            raise KeyError(f"nobody subscribed to {name}")
        return self._table(name)

    def _table(self, name: str) -> DataFrame:
        if name in self.sources:
            return self.sources[name]
        if name in self.kept:
            return self.kept[name]
        out = self.make[name](*map(self._table, self.needs[name]))
        self.made[name] += 1
        if self.readers[name]:
            out = self.kept[name] = out.persist(StorageLevel.MEMORY_AND_DISK)
        return out

    def stale(self) -> list[str]:
        """Subscribed tables that the next ``get`` has to make."""
        return sorted(n for n in self.readers if n in self.make and n not in self.kept)

"""Several sources beside each other, one row per key, in a single grouped aggregate.

Each source is narrowed to its keys and one structure, the sources are united,
and one ``groupBy`` finds the latest row of each and the aggregates of others
at once.  Partial aggregates are formed before the only shuffle, so a key with
very many rows sends one row per task, and no key has to be counted first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Latest:
    """Of each key the row with the highest ``order``, NULL last; the smallest ``tie`` among equals."""

    rows: DataFrame
    order: Column
    tie: Column
    columns: Sequence[str]

    def narrowed(self) -> Column:
        # Bitwise not turns the order of whole numbers around.
        return F.struct(self.order.alias("order"), F.bitwise_not(self.tie).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in self.columns]).alias("row"))

    def chosen(self, name: str) -> Column:
        return F.max(name)["row"]


@dataclass(frozen=True)
class Grouped:
    """Aggregates over a key's rows; ``aggregates`` gets a function that finds a column of the row."""

    rows: DataFrame
    columns: Sequence[str]
    aggregates: Callable[[Callable[[str], Column]], Sequence[Column]]

    def narrowed(self) -> Column:
        return F.struct(*[F.col(f"`{c}`") for c in self.columns])

    def chosen(self, name: str) -> Column:
        found = F.struct(*self.aggregates(lambda c: F.col(f"`{name}`.`{c}`")))
        return F.when(F.count(name) > 0, found)


def beside(parts: Mapping[str, Latest | Grouped], keys: Sequence[str]) -> DataFrame:
    """One row per key found in any part: the keys and a structure per part, NULL where it has no row.

    NULL keys form keys of their own, as in any grouping.
    """
    narrowed = [part.rows.select(*keys, part.narrowed().alias(name)) for name, part in parts.items()]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), narrowed)
    return united.groupBy(*keys).agg(*[part.chosen(name).alias(name) for name, part in parts.items()])

"""Ordered strategies: each is tried only on what those before it have not settled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyr.operators.tables import settle


@dataclass(frozen=True)
class Strategy:
    """extract: the text from a row, or null; accept: whether that text will do; fits: which rows it can be tried on."""

    name: str
    extract: Callable[[DataFrame], Column]
    accept: Callable[[Column], Column]
    fits: Callable[[DataFrame], Column] = field(default=lambda rows: F.lit(True))


class Registry:
    """Strategies by priority, smallest first; equal priorities in the order in which they came."""

    def __init__(self) -> None:
        self._all: list[tuple[int, int, Strategy]] = []

    def register(self, priority: int, strategy: Strategy) -> None:
        if any(s.name == strategy.name for _, _, s in self._all):
            raise ValueError(f"a strategy {strategy.name} is known already")
        self._all.append((priority, len(self._all), strategy))

    @property
    def strategies(self) -> list[Strategy]:
        return [s for _, _, s in sorted(self._all, key=lambda x: x[:2])]


def first_accepted(rows: DataFrame, registry: Registry, stages: list[DataFrame] | None = None) -> DataFrame:
    """The columns of `rows`, method and result: the first strategy whose text is accepted; both null where none is.

    Each stage is written once, with what it accepts and what it passes on, so
    a costly strategy runs on the rows that need it alone.  `stages`, if given,
    is filled with the tables that the stages read.
    """
    columns, done, rest = rows.columns, None, rows
    for s in registry.strategies:
        if stages is not None:
            stages.append(rest)
        text = F.when(s.fits(rest), s.extract(rest))
        tried = settle(rest.select(*columns, text.alias("result")).withColumn("_ok", F.coalesce(s.accept(F.col("result")), F.lit(False))))
        own = tried.where("_ok").select(*columns, F.lit(s.name).alias("method"), "result")
        done = own if done is None else done.unionByName(own)
        rest = tried.where("not _ok").select(*columns)
    left = rest.select(*columns, F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("result"))
    return left if done is None else done.unionByName(left)

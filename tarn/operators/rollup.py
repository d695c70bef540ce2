"""Aggregating indexes: a stored rollup, and the rewrite of aggregates that it can answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How partial results of each aggregate combine, and what is stored for it.
PARTS = {"count": ("count",), "sum": ("sum",), "min": ("min",), "max": ("max",), "avg": ("sum", "count")}


@dataclass(frozen=True)
class Rollup:
    """Stored aggregates of measures by keys. The stored columns are named kind_measure; counts of rows are count_all."""

    keys: tuple[str, ...]
    measures: tuple[tuple[str, str], ...]  # (kind, column); column * for count(*)

    def stored(self) -> list[tuple[str, str]]:
        return list(dict.fromkeys((p, c) for kind, c in self.measures for p in PARTS[kind]))

    @staticmethod
    def name(kind: str, column: str) -> str:
        return f"{kind}_{'all' if column == '*' else column}"

    def build(self, df: DataFrame) -> DataFrame:
        made = {"count": lambda c: F.count("*" if c == "*" else c), "sum": F.sum, "min": F.min, "max": F.max}
        return df.groupBy(*self.keys).agg(*(made[k](c).alias(self.name(k, c)) for k, c in self.stored()))

    def refresh(self, index: DataFrame, more: DataFrame) -> DataFrame:
        """The index after rows were added: only the new rows are aggregated."""
        return self.combine(index.unionByName(self.build(more)), list(self.keys))

    def combine(self, parts: DataFrame, keys: list[str]) -> DataFrame:
        fold = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        return parts.groupBy(*keys).agg(*(fold[k](self.name(k, c)).alias(self.name(k, c)) for k, c in self.stored()))

    def answers(self, keys: list[str], aggregates: list[tuple[str, str]]) -> bool:
        return set(keys) <= set(self.keys) and all(k in PARTS and {(p, c) for p in PARTS[k]} <= set(self.stored()) for k, c in aggregates)

    def aggregate(self, index: DataFrame, base: DataFrame, keys: list[str], aggregates: list[tuple[str, str]], where=None) -> DataFrame:
        """keys and kind_measure columns; from the index if it can answer, else from the base. where may use the index's keys only."""
        if not self.answers(keys, aggregates):
            rows, done = base if where is None else base.where(where), Rollup(tuple(keys), tuple(aggregates))
            return done.finish(done.build(rows), keys, aggregates)
        return self.finish(self.combine(index if where is None else index.where(where), keys), keys, aggregates)

    def finish(self, df: DataFrame, keys: list[str], aggregates: list[tuple[str, str]]) -> DataFrame:
        out = [(F.col(self.name("sum", c)) / F.col(self.name("count", c)) if k == "avg" else F.col(self.name(k, c))).alias(self.name(k, c)) for k, c in aggregates]
        return df.select(*keys, *out)

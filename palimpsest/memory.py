"""A memory: six DataFrames, and the reads and writes over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import schema


@dataclass(frozen=True)
class Memory:
    """An immutable state. Writes return another Memory; a store makes it durable."""

    sources: DataFrame
    episodes: DataFrame
    entities: DataFrame
    facts: DataFrame
    fact_revisions: DataFrame
    entity_revisions: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Memory:
        return cls(**{name: spark.createDataFrame([], s) for name, s in schema.TABLES.items()})

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_tables(self, **changed: DataFrame) -> Memory:
        return replace(self, **changed)

    def settled(self) -> Memory:
        """The same state with short plans: every table from a checkpoint, for a run of writes without a store."""
        from palimpsest.sources.shared import cut

        return Memory(**{name: cut(df) for name, df in self.tables().items()})


class LazyMemory(Memory):
    """A memory whose tables are made at their first use: a read pays for those only that it needs."""

    def __init__(self, spark: SparkSession, makers: dict[str, Callable[[], DataFrame]]):
        object.__setattr__(self, "_spark", spark)
        object.__setattr__(self, "_makers", makers)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._makers:
            raise AttributeError(name)
        object.__setattr__(self, name, self._makers[name]())
        return getattr(self, name)

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def with_tables(self, **changed: DataFrame) -> Memory:
        return LazyMemory(self._spark, {name: (lambda name=name: changed[name]) if name in changed else (lambda name=name: getattr(self, name)) for name in self._makers})

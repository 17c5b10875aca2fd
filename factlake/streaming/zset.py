"""Signed multisets (Z-sets) as DataFrames: columns of values, and ``mult``.

Additions and retractions are rows with positive and negative ``mult``; consolidating sums them and drops what cancels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULT = "mult"


@dataclass(frozen=True)
class ZSet:
    df: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != MULT]

    def _cols(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.columns]

    @classmethod
    def of(cls, df: DataFrame, mult: int = 1) -> ZSet:
        """Every row of an ordinary DataFrame, ``mult`` times."""
        return cls(df.withColumn(MULT, F.lit(mult).cast("long")))

    @classmethod
    def of_diff(cls, additions: DataFrame, retractions: DataFrame) -> ZSet:
        return cls.of(additions) + cls.of(retractions, -1)

    def __add__(self, other: ZSet) -> ZSet:
        return ZSet(self.df.unionByName(other.df))

    def __neg__(self) -> ZSet:
        return ZSet(self.df.withColumn(MULT, -F.col(MULT)))

    def __sub__(self, other: ZSet) -> ZSet:
        return self + -other

    def consolidate(self) -> ZSet:
        cols = self._cols()
        summed = (self.df.groupBy(*cols) if cols else self.df.groupBy()).agg(F.sum(MULT).alias(MULT))
        return ZSet(summed.where(f"{MULT} <> 0"))

    def map(self, *cols: Column) -> ZSet:
        return ZSet(self.df.select(*cols, MULT))

    def filter(self, cond: Column) -> ZSet:
        return ZSet(self.df.where(cond))

    def join(self, other: ZSet) -> ZSet:
        """Natural join; multiplicities multiply."""
        shared = [c for c in self.columns if c in other.columns]
        right = other.df.withColumnRenamed(MULT, "__m")
        both = self.df.join(right, shared) if shared else self.df.crossJoin(right)
        return ZSet(both.withColumn(MULT, F.col(MULT) * F.col("__m")).drop("__m"))

    def distinct(self) -> ZSet:
        """Each value with a positive multiplicity, once."""
        return ZSet(self.consolidate().df.where(f"{MULT} > 0").withColumn(MULT, F.lit(1).cast("long")))

    def count(self, value: Column) -> Column:
        return F.sum(F.when(value, F.col(MULT)).otherwise(0))

    def group(self, keys: list[str], **aggregates: Column) -> DataFrame:
        return self.df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[c.alias(n) for n, c in aggregates.items()])

    def values(self) -> DataFrame:
        """Rows as often as they occur; negative ones don't."""
        return self.df.where(f"{MULT} > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(MULT)))).select(*self._cols())

    def diff(self) -> tuple[DataFrame, DataFrame]:
        """Additions and retractions of a consolidated Z-set."""
        own = self.consolidate().df
        return own.where(f"{MULT} > 0").drop(MULT), own.where(f"{MULT} < 0").drop(MULT)

    def staged(self, stage: Callable[[DataFrame], DataFrame]) -> ZSet:
        return ZSet(stage(self.df))


def transitions(before: ZSet, change: ZSet) -> tuple[ZSet, ZSet]:
    """The set of ``before + change`` as against ``before``: +1 for what appears, -1 for what disappears; and the new multiset."""
    cols = change.columns
    keys = change.consolidate().df.withColumnRenamed(MULT, "__d")
    old = before.df.withColumnRenamed(MULT, "__o")
    cond = None
    for c in cols:
        same = F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`"))
        cond = same if cond is None else cond & same
    both = keys.alias("n").join(old.alias("o"), cond if cond is not None else F.lit(True), "left")
    was, now = F.coalesce("__o", F.lit(0)), F.coalesce("__o", F.lit(0)) + F.col("__d")
    sign = (now > 0).cast("long") - (was > 0).cast("long")
    moved = both.select(*[F.col(f"n.`{c}`").alias(c) for c in cols], sign.alias(MULT)).where(f"{MULT} <> 0")
    return ZSet(moved), (before + change).consolidate()


def merged(before: ZSet, change: ZSet) -> ZSet:
    """The first of :func:`transitions` by one grouping of both: for a change too large to look up what it meets. Neither need be consolidated."""
    cols, none = change.columns, F.lit(0).cast("long")
    own = [z.df.select(*change._cols(), o.alias("__o"), d.alias("__d")) for z, o, d in ((before, F.col(MULT), none), (change, none, F.col(MULT)))]
    sums = own[0].unionByName(own[1]).groupBy(*change._cols()).agg(F.sum("__o").alias("__o"), F.sum("__d").alias("__d")).where("__d <> 0")
    sign = (F.col("__o") + F.col("__d") > 0).cast("long") - (F.col("__o") > 0).cast("long")
    return ZSet(sums.select(*[F.col(f"`{c}`") for c in cols], sign.alias(MULT)).where(f"{MULT} <> 0"))

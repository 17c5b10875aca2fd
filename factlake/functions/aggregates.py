"""The twelve aggregates of queries as columns, each over the distinct bindings of its group."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Aggregate:
    """``make(column, type, *params)``; ``linear``: maintained from sums of signed changes alone."""

    make: Callable[..., Column]
    params: int = 0
    linear: bool = False


def _sum(c: Column, t: T.DataType) -> Column:
    zero = F.lit(0.0) if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)) else F.lit(0).cast("long")
    return F.coalesce(F.sum(c), zero)


def _random(c: Column, t: T.DataType) -> Column:
    return F.try_element_at(F.shuffle(F.collect_list(c)), F.lit(1))


AGGREGATES: dict[str, Aggregate] = {
    "count": Aggregate(lambda c, t: F.count(F.lit(1)), linear=True),  # null counts too
    "sum": Aggregate(_sum, linear=True),
    "avg": Aggregate(lambda c, t: F.coalesce(F.avg(c), F.lit(0.0)), linear=True),
    "min": Aggregate(lambda c, t: F.min(c)),
    "max": Aggregate(lambda c, t: F.max(c)),
    "count-distinct": Aggregate(lambda c, t: F.count_distinct(c)),
    "variance": Aggregate(lambda c, t: F.coalesce(F.var_pop(c), F.lit(0.0))),
    "stddev": Aggregate(lambda c, t: F.coalesce(F.stddev_pop(c), F.lit(0.0))),
    "median": Aggregate(lambda c, t: F.median(c)),
    "collect": Aggregate(lambda c, t: F.sort_array(F.collect_list(c))),
    "sample": Aggregate(lambda c, t, k: F.slice(F.shuffle(F.collect_list(c)), 1, k), params=1),
    "rand": Aggregate(_random),
}

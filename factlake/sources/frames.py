"""DataFrames as a read-only log of facts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import KINDS, Fact, Store, fact_of, schema


def facts(df: DataFrame, entity: str, attribute: str, kind: str, value: str, tx: str, dims: Mapping[str, str] | None = None, time: str | None = None, entity_type: str = "long") -> DataFrame:
    """Rows as assertions in a store's schema; arguments are SQL expressions over ``df``, ``dims`` from dimension to expression."""
    pairs = [x for d, c in (dims or {}).items() for x in (F.lit(d), F.expr(c).cast("timestamp"))]
    cols = {"e": F.expr(entity), "a": F.expr(attribute), "kind": F.lit(kind), "tx_id": F.expr(tx), "seq": F.lit(0), "t": F.expr(time or "NULL").cast("timestamp"), "op": F.lit("assert"), "many": F.lit(False)}
    cols[KINDS[kind]] = F.expr(value)
    cols["dims"] = F.create_map(*pairs) if pairs else F.lit(None)
    return df.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(entity_type)])


class FrameStore(Store):
    """Facts that a DataFrame holds, with the kinds of its attributes' values told in advance: nothing is scanned before a query is."""

    def __init__(self, spark: SparkSession, df: DataFrame, kinds: Mapping[str, str], many: Iterable[str] = (), entity: str = "long"):
        self.spark, self.df, self.entity = spark, df, entity
        self.kinds = {a: ({k}, a in set(many)) for a, k in kinds.items()}

    def append(self, facts: list[Fact]) -> None:
        raise TypeError("this log is read-only")

    def append_frame(self, df: DataFrame) -> None:
        raise TypeError("this log is read-only")

    def scan(self) -> DataFrame:
        return self.df

    def of(self, keys: Iterable[tuple[object, str]]) -> dict[tuple[object, str], list[Fact]]:
        keys = set(keys)
        out: dict[tuple, list[Fact]] = {k: [] for k in keys}
        if keys:
            own = self.df.where(F.col("a").isin([a for _, a in keys]) & F.col("e").isin([e for e, _ in keys]))
            for r in own.orderBy("tx_id", "seq").collect():  # of the given entities
                if (r["e"], r["a"]) in out:
                    out[r["e"], r["a"]].append(fact_of(r))
        return out

    def find(self, a: str, v: object) -> set:
        if a not in self.kinds:
            return set()
        column = KINDS[next(iter(self.kinds[a][0]))]
        return {r["e"] for r in self.df.where((F.col("a") == a) & (F.col(column) == v)).select("e").distinct().collect()}

    def attributes(self) -> dict[str, tuple[set[str], bool]]:
        return self.kinds

    def tops(self) -> tuple[int, int]:
        return 0, 0

    def delete(self, e: object, a: str | None = None) -> None:
        raise TypeError("this log is read-only")

    def restore(self, snapshot: int) -> None:
        self.df = self.df.where(F.col("tx_id") <= snapshot)

"""Attributes by name: columns of tables, and facts of a log, as relations of entity and value."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class MappedTable:
    """A DataFrame as attributes ``:name/column``; the entity is the value of ``key``.

    ``key`` None: every row is an entity of its own. Its number is made only where a query needs it: a hash of the row, and
    the place among equal rows.
    """

    name: str
    df: DataFrame
    key: str | None
    entity: str = "__e"

    def attributes(self) -> dict[str, str]:
        return {f":{self.name}/{c}": c for c in self.df.columns if c != self.entity}

    def rows(self, numbered: bool) -> DataFrame:
        """The table with the entity as a column of its own, if the query needs it."""
        if self.key is not None:
            return self.df.withColumn(self.entity, F.col(self.key)).where(F.col(self.key).isNotNull())
        if not numbered:
            return self.df
        cols = [F.col(f"`{c}`") for c in self.df.columns]
        h = self.df.withColumn("__h", F.xxhash64(*cols))
        place = F.row_number().over(Window.partitionBy("__h", *cols).orderBy(F.lit(0)))
        return h.withColumn(self.entity, F.concat_ws("-", "__h", place)).drop("__h")


@dataclass
class Catalog:
    """What attribute names mean, for one query."""

    tables: dict[str, MappedTable] = field(default_factory=dict)
    columns: dict[str, tuple[MappedTable, str]] = field(default_factory=dict)

    def map_table(self, name: str, df: DataFrame, key: str | None) -> MappedTable:
        if name in self.tables:
            raise ValueError(f"table {name} is mapped already")
        t = self.tables[name] = MappedTable(name, df, key)
        for a, c in t.attributes().items():
            self.columns[a] = (t, c)
        return t


def literal(value: object, kind: T.DataType) -> Column | None:
    """A constant to compare with a column of ``kind``; None if no value of that kind can equal it."""
    number = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    if isinstance(value, bool):
        return F.lit(value) if isinstance(kind, T.BooleanType) else None
    if isinstance(value, (int, float)):
        return F.lit(value) if isinstance(kind, number) else None
    if isinstance(value, str):
        return F.lit(str(value)) if isinstance(kind, T.StringType) else None
    if value is None:
        return None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and hasattr(value, "isoformat"):
        return F.lit(value).cast("timestamp")
    if isinstance(kind, T.ArrayType) and isinstance(value, (tuple, list)):
        return F.array(*map(F.lit, value)).cast(kind)
    return None

"""Pull: entities with chosen attributes, references followed to any depth, as nested structs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import edn
from ..plans.ast import QueryError


def specs(pattern: object) -> list[tuple[str, object, int | None]]:
    """(attribute, nested pattern or None, limit or None) of each entry."""
    if isinstance(pattern, str):
        pattern = edn.read(pattern)
    out = []
    for x in pattern:
        if isinstance(x, Mapping):
            limit = x.get(":limit")
            own = [(k, v) for k, v in x.items() if k != ":limit"]
            if len(own) != 1:
                raise QueryError(f"one reference expected in {x}")
            out.append((str(own[0][0]), own[0][1], limit))
        elif str(x) == "*" or str(x).startswith(":"):
            out.append((str(x), None, None))
        else:
            raise QueryError(f"{x} is no part of a pull pattern")
    return out


def reverse_of(a: str) -> str | None:
    """``:ns/x`` for ``:ns/_x``, else None."""
    ns, _, name = a.rpartition("/")
    return f"{ns}/{name[1:]}" if name.startswith("_") else None


def pull(source: object, ids: DataFrame, pattern: object, as_of: Mapping[str, object]) -> DataFrame:
    """``id, pulled`` for a DataFrame of distinct ``id``: a struct of ``:db/id`` and the pattern's attributes.

    Attributes that an entity doesn't have are null; many values and reverse references are arrays, in order; ``*`` is a map of
    all attributes to their values as text. ``ids`` is used once for each attribute.
    """
    out, fields = ids, [F.col("id").alias(":db/id")]
    for i, (a, nested, limit) in enumerate(specs(pattern)):
        name = f"__{i}"
        if a == "*":
            own, field = source.all_attributes(as_of), F.col(name)
            own = own.select(F.col("e").alias("__e"), F.col("attributes").alias(name))
        else:
            own, field = _attribute(source, ids, a, nested, limit, as_of, name)
        out = out.join(own, F.col("id") == F.col("__e"), "left").drop("__e")
        fields.append(field.alias(a if a != "*" else "*"))
    return out.select("id", F.struct(*fields).alias("pulled"))


def _attribute(source: object, ids: DataFrame, a: str, nested: object, limit: int | None, as_of: Mapping, name: str) -> tuple[DataFrame, Column]:
    back = reverse_of(a)
    edges, single = source.references(back or a, as_of)
    if back:
        edges, single = edges.select(F.col("v").alias("e"), F.col("e").alias("v")), False
    if isinstance(edges.schema["v"].dataType, T.ArrayType) and nested is not None:
        kind = ids.schema["id"].dataType
        edges, single = edges.select("e", F.posexplode("v").alias("pos", "v")).select("e", F.col("v").cast(kind).alias("v"), "pos"), False
    edges = edges.join(ids.select(F.col("id").alias("e")), "e", "left_semi")
    value = F.col("v")
    if nested is not None:
        below = pull(source, edges.select(F.col("v").alias("id")).where("id IS NOT NULL").distinct(), nested, as_of)
        edges = edges.join(below.withColumnRenamed("id", "v"), "v")
        value = F.col("pulled")
    if single:
        return edges.select(F.col("e").alias("__e"), value.alias(name)), F.col(name)
    place = F.col("pos") if "pos" in edges.columns else F.col("v")
    many = F.sort_array(F.collect_list(F.struct(place.alias("place"), value.alias("value"))))
    if limit is not None:
        many = F.slice(many, 1, limit)
    return edges.groupBy(F.col("e").alias("__e")).agg(F.transform(many, lambda x: x["value"]).alias(name)), F.col(name)

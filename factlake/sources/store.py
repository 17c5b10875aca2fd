"""Stores of the fact log: in memory, and as Parquet files.

A fact is ``e, a, v, tx_id, seq, t, op`` and the transaction's time dimensions. ``op`` is ``assert`` or ``retract``; ``seq`` is its
place in the transaction. Values lie in one column for each kind, so that every attribute reads as a typed relation.
"""

from __future__ import annotations

import json
import threading
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import files, read_text, stage, write_text

#: Value columns by kind.
KINDS = {"long": "v_long", "double": "v_double", "string": "v_string", "boolean": "v_boolean", "instant": "v_instant", "vector": "v_json", "map": "v_json", "nil": "v_json"}


@dataclass(frozen=True)
class Fact:
    e: object
    a: str
    v: object
    tx_id: int
    seq: int
    t: datetime
    op: str
    dims: dict = field(default_factory=dict, hash=False)
    many: bool = False


def kind_of(v: object) -> str:
    """The kind of a value; a set has none of its own: its elements are facts."""
    if v is None:
        return "nil"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "long"
    if isinstance(v, float):
        return "double"
    if isinstance(v, str):
        return "string"
    if isinstance(v, datetime):
        return "instant"
    if isinstance(v, (list, tuple)):
        return "vector"
    if isinstance(v, dict):
        return "map"
    raise TypeError(f"a value of type {type(v).__name__} cannot be stored")


def _json(v: object) -> str:
    return json.dumps(v, sort_keys=True, default=lambda x: {"#inst": x.isoformat()} if isinstance(x, datetime) else sorted(x, key=str))


def schema(entity: str) -> T.StructType:
    return T.StructType([
        T.StructField("e", T.StringType() if entity == "string" else T.LongType()), T.StructField("a", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("v_long", T.LongType()), T.StructField("v_double", T.DoubleType()), T.StructField("v_string", T.StringType()), T.StructField("v_boolean", T.BooleanType()),
        T.StructField("v_instant", T.TimestampType()), T.StructField("v_json", T.StringType()), T.StructField("tx_id", T.LongType()), T.StructField("seq", T.LongType()),
        T.StructField("t", T.TimestampType()), T.StructField("op", T.StringType()), T.StructField("many", T.BooleanType()), T.StructField("dims", T.MapType(T.StringType(), T.TimestampType())),
        T.StructField("nums", T.MapType(T.StringType(), T.LongType())),
    ])


def row_of(f: Fact) -> tuple:
    kind = kind_of(f.v)
    values = dict.fromkeys(("v_long", "v_double", "v_string", "v_boolean", "v_instant", "v_json"))
    values[KINDS[kind]] = _json(f.v) if KINDS[kind] == "v_json" else str(f.v) if kind == "string" else f.v
    return (f.e, f.a, kind, *values.values(), f.tx_id, f.seq, f.t, f.op, f.many, {k: v for k, v in f.dims.items() if isinstance(v, datetime)}, {k: v for k, v in f.dims.items() if isinstance(v, int)})


def fact_of(r: object) -> Fact:
    column = KINDS[r["kind"]]
    v = r[column]
    if column == "v_json":
        v = json.loads(v, object_hook=lambda m: datetime.fromisoformat(m["#inst"]) if set(m) == {"#inst"} else m)
    if r["kind"] == "instant":
        v = v.replace(tzinfo=timezone.utc) if v.tzinfo is None else v
    return Fact(r["e"], r["a"], v, r["tx_id"], r["seq"], r["t"], r["op"], {**{k: _aware(x) for k, x in (r["dims"] or {}).items()}, **(r["nums"] or {})}, bool(r["many"]))


def _aware(t: datetime) -> datetime:
    return t.astimezone(timezone.utc)


def kinds_of(facts: Iterable[Fact]) -> dict[str, tuple[set[str], bool]]:
    """Kinds of the values of each attribute, and whether it had many at a time."""
    out: dict[str, tuple[set[str], bool]] = {}
    for f in facts:
        kinds, many = out.get(f.a, (set(), False))
        out[f.a] = (kinds | ({kind_of(f.v)} - {"nil"}), many or f.many)
    return out


class Store(ABC):
    """Where facts are kept: an append is atomic, and a scan is a DataFrame."""

    @abstractmethod
    def append(self, facts: list[Fact]) -> None:
        """Add the facts of one transaction, all or none."""

    @abstractmethod
    def append_frame(self, df: DataFrame) -> None:
        """Add facts in bulk, as a DataFrame of the store's schema."""

    @abstractmethod
    def scan(self) -> DataFrame:
        """All facts."""

    @abstractmethod
    def of(self, keys: Iterable[tuple[object, str]]) -> dict[tuple[object, str], list[Fact]]:
        """The facts of some (entity, attribute) pairs."""

    @abstractmethod
    def find(self, a: str, v: object) -> set:
        """Entities of which some fact says that ``a`` is ``v``."""

    def times(self, entities: list) -> dict[object, dict[str, object]]:
        """For each of some entities the last time that it has in each dimension."""
        rows = self.scan().where(F.col("e").isin(entities)).select("e", "tx_id", "seq", F.explode("dims").alias("d", "at"))
        last = rows.groupBy("e", "d").agg(F.max_by("at", F.struct("tx_id", "seq")).alias("at")).collect()  # of one transaction's entities
        out: dict[object, dict[str, object]] = {}
        for r in last:
            out.setdefault(r["e"], {})[r["d"]] = _aware(r["at"])
        return out

    def first(self, a: str, v: object, many: bool) -> object:
        """The first entity, in order of its number's text, of which ``a`` is ``v`` now; None if there is none."""
        from ..operators.temporal import holding

        now = self.of([(e, a) for e in self.find(a, v)])
        return min((e for (e, _), fs in now.items() if v in holding(fs, many)), key=str, default=None)

    @abstractmethod
    def attributes(self) -> dict[str, tuple[set[str], bool]]:
        """Kinds of the values of each attribute, and whether it ever had many at a time."""

    @abstractmethod
    def tops(self) -> tuple[int, int]:
        """Greatest transaction and entity numbers."""

    def stream(self, a: str | None = None) -> Iterator[Fact]:
        """Facts one at a time, as Spark delivers them, in order of transaction: all pass the driver. :meth:`numbered` has them on the executors."""
        return map(fact_of, self._in_order(a).toLocalIterator(prefetchPartitions=True))

    def numbered(self, a: str | None = None) -> DataFrame:
        """Facts in order of transaction with their places in it, ``i`` from 1: sorted into ranges, of which the driver sees none."""
        own = stage(self._in_order(a).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("__at")))
        before = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        firsts = own.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows")).select("__part", F.coalesce(before, F.lit(0)).alias("__first"))  # a row a range
        return own.join(firsts, "__part").withColumn("i", F.col("__first") + F.col("__at") + 1).drop("__part", "__at", "__first")

    def _in_order(self, a: str | None) -> DataFrame:
        return (self.scan() if a is None else self.scan().where(F.col("a") == a)).orderBy("tx_id", "seq")

    def snapshot(self) -> int:
        """A number to give to ``restore``."""
        return self.tops()[0]

    @abstractmethod
    def restore(self, snapshot: int) -> None:
        """Forget everything after a snapshot."""

    @abstractmethod
    def delete(self, e: object, a: str | None = None) -> None:
        """Forget an entity's facts, of one attribute or of all, as if they had never been there."""

    def compact(self) -> None:
        """Join small files."""

    def close(self) -> None:
        """Let go of what is held in memory."""


class MemoryStore(Store):
    """Facts in the driver's memory, for small data and tests; scans become DataFrames."""

    def __init__(self, spark: SparkSession, entity: str = "long"):
        self.spark, self.entity = spark, entity
        self._clear([])

    def _clear(self, facts: list[Fact]) -> None:
        self.facts: list[Fact] = []
        self.by_key: dict[tuple, list[Fact]] = {}
        self.by_value: dict[tuple, set] = {}
        self.kinds: dict[str, tuple[set[str], bool]] = {}
        self.moments: dict[object, dict[str, object]] = {}
        self._frame: tuple[int, DataFrame] | None = None
        self.append(facts)

    def append(self, facts: list[Fact]) -> None:
        for f in facts:
            self.by_key.setdefault((f.e, f.a), []).append(f)
            self.by_value.setdefault((f.a, _json(f.v)), set()).add(f.e)
            self.moments.setdefault(f.e, {}).update({d: x for d, x in f.dims.items() if isinstance(x, datetime)})
        for a, (kinds, many) in kinds_of(facts).items():
            own = self.kinds.get(a, (set(), False))
            self.kinds[a] = (own[0] | kinds, own[1] or many)
        self.facts += facts

    def append_frame(self, df: DataFrame) -> None:
        self.append([fact_of(r) for r in df.collect()])  # this store is the driver's memory

    def scan(self) -> DataFrame:
        if self._frame is None or self._frame[0] != len(self.facts):
            self._frame = (len(self.facts), self.spark.createDataFrame([row_of(f) for f in self.facts], schema(self.entity)))
        return self._frame[1]

    def of(self, keys: Iterable[tuple[object, str]]) -> dict[tuple[object, str], list[Fact]]:
        return {k: self.by_key.get(k, []) for k in keys}

    def find(self, a: str, v: object) -> set:
        return self.by_value.get((a, _json(v)), set())

    def times(self, entities: list) -> dict[object, dict[str, object]]:
        return {e: self.moments.get(e, {}) for e in entities}

    def delete(self, e: object, a: str | None = None) -> None:
        self._clear([f for f in self.facts if f.e != e or a is not None and f.a != a])

    def entity_attributes(self, e: object) -> set[str]:
        return {a for x, a in self.by_key if x == e}

    def attributes(self) -> dict[str, tuple[set[str], bool]]:
        return self.kinds

    def tops(self) -> tuple[int, int]:
        return max((f.tx_id for f in self.facts), default=0), max((f.e for f in self.facts if isinstance(f.e, int)), default=0)

    def restore(self, snapshot: int) -> None:
        self._clear([f for f in self.facts if f.tx_id <= snapshot])


class ParquetStore(Store):
    """Facts as Parquet files, below each append's folder one for each attribute: reading an attribute reads its folders only.

    An append is there when its commit file is, which is made last and in one step; files without one are never read. A commit
    file also has the kinds of the append's attributes and its greatest numbers, so neither needs a scan. ``compression``: none,
    snappy, lz4 or zstd. ``compact`` joins small appends.
    """

    def __init__(self, spark: SparkSession, path: str, entity: str = "long", compression: str = "zstd"):
        if compression not in ("none", "snappy", "lz4", "zstd"):
            raise ValueError(f"unknown compression {compression}")
        self.spark, self.path, self.entity, self.compression = spark, path.rstrip("/"), entity, compression
        self.lock = threading.RLock()
        self._known: dict[str, dict] = {}

    def _data(self) -> str:
        """The folder of the current version of the log."""
        return f"{self.path}/{(read_text(self.spark, f'{self.path}/CURRENT') or 'log-0').strip()}"

    def _commits(self) -> dict[str, dict]:
        """What is committed: each append's folder and what its file says."""
        with self.lock:
            data = self._data()
            fs, p = files(self.spark, f"{data}/commits")
            names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
            found = {f"{data}/{n}": n for n in names if n.startswith("part=") and not n.endswith(".tmp")}
            self._known = {f: self._known[f] if f in self._known else json.loads(read_text(self.spark, f"{data}/commits/{n}")) for f, n in found.items()}
            return dict(self._known)

    def append(self, facts: list[Fact]) -> None:
        if facts:
            df = self.spark.createDataFrame([row_of(f) for f in facts], schema(self.entity)).coalesce(1)
            self._append(df, self._data(), {a: [sorted(k), m] for a, (k, m) in kinds_of(facts).items()}, max(f.tx_id for f in facts), max((f.e for f in facts if isinstance(f.e, int)), default=0))

    def append_frame(self, df: DataFrame) -> None:
        self._append(df, self._data())

    def _append(self, df: DataFrame, data: str, kinds: dict | None = None, tx: int = 0, e: int = 0) -> None:
        with self.lock:
            name = f"part=p{uuid.uuid4().hex}"
            own = df.select(*[F.col(c.name).cast(c.dataType) for c in schema(self.entity)])
            own.write.partitionBy("a").option("compression", self.compression).parquet(f"{data}/{name}")
            if kinds is None:
                top = F.max("e") if self.entity == "long" else F.lit(0)
                rows = self._at([f"{data}/{name}"], data).groupBy("a").agg(F.collect_set("kind").alias("k"), F.max("many").alias("m"), F.max("tx_id").alias("t"), top.alias("e")).collect()  # a row an attribute
                kinds = {r["a"]: [sorted(set(r["k"]) - {"nil"}), bool(r["m"])] for r in rows}
                tx, e = max((r["t"] or 0 for r in rows), default=0), max((r["e"] or 0 for r in rows), default=0)
            write_text(self.spark, f"{data}/commits/{name}", json.dumps({"kinds": kinds, "tx": tx, "e": e}))

    def _at(self, folders: list[str], data: str) -> DataFrame:
        return self.spark.read.schema(schema(self.entity)).option("basePath", data).parquet(*folders)

    def scan(self) -> DataFrame:
        folders = [f for f, c in self._commits().items() if c["kinds"]]
        if not folders:
            return self.spark.createDataFrame([], schema(self.entity))
        return self._at(folders, folders[0].rsplit("/", 1)[0]).select(*[c.name for c in schema(self.entity)])

    def of(self, keys: Iterable[tuple[object, str]]) -> dict[tuple[object, str], list[Fact]]:
        keys = set(keys)
        if not keys:
            return {}
        es, attrs = list({e for e, _ in keys}), list({a for _, a in keys})
        out: dict[tuple, list[Fact]] = {k: [] for k in keys}
        for r in self.scan().where(F.col("a").isin(attrs) & F.col("e").isin(es)).orderBy("tx_id", "seq").collect():  # of one transaction's entities
            if (r["e"], r["a"]) in out:
                out[r["e"], r["a"]].append(fact_of(r))
        return out

    def _with(self, a: str, v: object) -> DataFrame:
        column = KINDS[kind_of(v)]
        value = F.lit(_json(v) if column == "v_json" else str(v) if column == "v_string" else v)
        return self.scan().where((F.col("a") == a) & (F.col(column) == value))

    def find(self, a: str, v: object) -> set:
        return {r["e"] for r in self._with(a, v).select("e").distinct().collect()}

    def first(self, a: str, v: object, many: bool) -> object:
        from ..operators.temporal import current

        own = self.scan().where(F.col("a") == a).join(self._with(a, v).select("e").distinct(), "e", "left_semi")
        column = KINDS[kind_of(v)]
        value = F.lit(_json(v) if column == "v_json" else str(v) if column == "v_string" else v)
        return current(own, many).where(F.col(column) == value).agg(F.min_by("e", F.col("e").cast("string"))).first()[0]

    def attributes(self) -> dict[str, tuple[set[str], bool]]:
        out: dict[str, tuple[set[str], bool]] = {}
        for c in self._commits().values():
            for a, (kinds, many) in c["kinds"].items():
                own = out.get(a, (set(), False))
                out[a] = (own[0] | set(kinds), own[1] or many)
        return out

    def tops(self) -> tuple[int, int]:
        commits = self._commits().values()
        return max((c["tx"] for c in commits), default=0), max((c["e"] for c in commits), default=0)

    def _rewrite(self, df: DataFrame) -> None:
        """Write a new version beside the old one and switch to it."""
        with self.lock:
            old = self._data()
            new = f"log-{int(old.rsplit('-', 1)[1]) + 1}"
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self._append(df.repartitionByRange(parts, "a", "e").sortWithinPartitions("a", "e", "tx_id", "seq"), f"{self.path}/{new}")
            write_text(self.spark, f"{self.path}/CURRENT", new)
            fs, p = files(self.spark, old)
            fs.delete(p, True)

    def restore(self, snapshot: int) -> None:
        self._rewrite(self.scan().where(F.col("tx_id") <= snapshot))

    def delete(self, e: object, a: str | None = None) -> None:
        gone = F.col("e") == e if a is None else (F.col("e") == e) & (F.col("a") == a)
        self._rewrite(self.scan().where(~gone))

    def compact(self) -> None:
        self._rewrite(self.scan())

    def destroy(self) -> None:
        """Delete all files."""
        fs, p = files(self.spark, self.path)
        fs.delete(p, True)

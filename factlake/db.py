"""The database: facts, mapped tables, queries, standing queries."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pull as pulling
from .operators.temporal import SYSTEM, Dimensions, as_of_filter, current, holding, typed_value, utc
from .operators.transact import Delta, TransactionError, Transactor, operations, read
from .plans import ast
from .plans.ast import Query
from .plans.planner import Planner
from .sources.catalog import Catalog, MappedTable
from .sources.store import KINDS, Fact, MemoryStore, Store

log = logging.getLogger(__name__)


class Database:
    """Facts in a store, tables as attributes, and queries over both.

    ``entity``: ``long`` or ``string``, the type of entity ids. Tables are mapped with :meth:`map_table`; they have no history.
    """

    def __init__(self, spark: SparkSession, store: Store | None = None, entity: str = "long"):
        self.spark, self.store = spark, store if store is not None else MemoryStore(spark, entity)
        self.catalog, self.dimensions = Catalog(), Dimensions()
        self.many: dict[str, bool] = {}
        self.listeners: list[Callable] = []
        self.subscriptions: list = []
        self.lock = threading.RLock()
        self.last_tx, self.last_entity = self.store.tops()
        self._read_dimensions()

    # -- set-up

    def map_table(self, name: str, df: DataFrame, key: str | None) -> MappedTable:
        """Show a DataFrame's columns as attributes ``:name/column`` of entities numbered by ``key`` (None: a row each)."""
        return self.catalog.map_table(name, df, key)

    def declare(self, attribute: str, many: bool) -> None:
        """Fix whether an attribute has many values at a time."""
        self.many[attribute] = many

    def add_listener(self, listener: Callable[[Database, list[Delta]], None]) -> None:
        self.listeners.append(listener)

    def _read_dimensions(self) -> None:
        for e in sorted(self.store.find(":dimension/type", ":instant") | self.store.find(":dimension/type", ":duration"), key=str):
            if m := self.entity(e):
                if ":dimension/name" in m:
                    self.dimensions.define(m)

    # -- writing

    def _next_id(self, e: object) -> object:
        if e is None:
            self.last_entity += 1
            return self.last_entity if self.store.entity == "long" else str(self.last_entity)
        if isinstance(e, int) and self.store.entity == "long":
            self.last_entity = max(self.last_entity, e)
            return e
        if self.store.entity == "long":
            raise TransactionError(f"{e!r}: this database has integer ids; Database(..., entity='string') has others")
        return str(e)

    def transact(self, data: object, time_dimensions: Mapping | None = None, tx_meta: Mapping | None = None) -> dict:
        """Apply a transaction: maps, operations, EDN text, or a map with ``:tx-data, :tx-meta, :time-dimensions``. All of it or none."""
        items, meta, dims = read(data)
        meta, dims = {**meta, **(tx_meta or {})}, {**dims, **(time_dimensions or {})}
        with self.lock:
            saved = self.last_entity
            try:
                ops = operations(items)
                now = datetime.now(timezone.utc)
                tx = {**meta, ":tx/id": self.last_tx + 1, ":tx/time": now}
                transactor = Transactor(self.store, self._next_id, self.many)
                facts, deltas = transactor.run(ops, tx, {})
                entities = list(dict.fromkeys(d.entity for d in deltas))
                full = self.dimensions.complete(dims, now, entities, self.store.times)
            except Exception:
                self.last_entity = saved
                raise
            own = {d: v for d, v in full.items() if d != SYSTEM}
            facts = [Fact(f.e, f.a, f.v, f.tx_id, f.seq, f.t, f.op, own, f.many) for f in facts]
            deltas = [Delta(d.entity, d.attribute, d.old_value, d.new_value, d.operation, d.tx, full, d.asserted, d.retracted) for d in deltas]
            self.store.append(facts)
            self.last_tx += 1
            for e in {d.entity for d in deltas if d.attribute == ":dimension/name"}:
                self.dimensions.define({d.attribute: d.new_value for d in deltas if d.entity == e})
            result = {":tx-id": tx[":tx/id"], ":tx-time": now, ":deltas": deltas}
        for f in list(self.listeners):
            try:
                f(self, deltas)
            except Exception:
                log.exception("a listener failed")
        for s in list(self.subscriptions):
            s.on_transaction(deltas, full)
        return result

    def load_facts(self, df: DataFrame) -> None:
        """Append facts in bulk, from a DataFrame of the store's schema."""
        with self.lock:
            self.store.append_frame(df)
            self.last_tx, self.last_entity = (max(a, b) for a, b in zip((self.last_tx, self.last_entity), self.store.tops(), strict=True))

    # -- what planners ask

    def column(self, a: str) -> tuple[MappedTable, str] | None:
        return self.catalog.columns.get(a)

    def _single(self, a: str) -> bool:
        return not self.many.get(a, self.store.attributes().get(a, (set(), False))[1])

    def facts(self, a: str, as_of: Mapping[str, object], dims: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
        """``e, v`` of an attribute as of some times, and whether it has one value at a time; with ``dims``, every version that has them, as ``t0`` ..."""
        if (found := self.column(a)) is not None:
            t, c = found
            return t.rows(True).select(F.col(t.entity).alias("e"), F.col(f"`{c}`").alias("v")).where("v IS NOT NULL"), True
        kinds, _ = self.store.attributes().get(a, (set(), False))
        value, kind = typed_value(kinds)
        own = self.store.scan().where(F.col("a") == a)
        if dims:
            self.dimensions.require(dims)
            own = own.where("op = 'assert'")
            for d in dims:
                at = self.dimensions.moment(d)
                own = own.where(at.isNotNull() & (at <= F.lit(utc(as_of[d])) if d in as_of else F.lit(True)))
            if ":tx" in as_of:
                own = own.where(F.col("tx_id") <= as_of[":tx"])
            return own.select("e", value.alias("v"), *[self.dimensions.moment(d).alias(f"t{i}") for i, d in enumerate(dims)]), False
        single = self._single(a)
        own = current(own.where(as_of_filter(as_of)), not single, None if kinds == {"long", "double"} else F.col(KINDS[kind]))
        return own.select("e", value.alias("v")), single

    def edges(self, a: str, as_of: Mapping[str, object]) -> DataFrame:
        df, _ = self.facts(a, as_of)
        return df.select(F.col("e").alias("src"), F.col("v").cast(df.schema["e"].dataType).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")

    def references(self, a: str, as_of: Mapping[str, object]) -> tuple[DataFrame, bool]:
        return self.facts(a, as_of)

    def all_attributes(self, as_of: Mapping[str, object]) -> DataFrame:
        """``e, attributes``: a map of every attribute to its values as text (many: joined by a comma, in order)."""
        text = F.coalesce(*[F.col(c).cast("string") for c in ("v_string", "v_long", "v_double", "v_boolean", "v_instant", "v_json")])
        many = [a for a in {*self.store.attributes(), *self.many} if not self._single(a)]
        own = self.store.scan().where(as_of_filter(as_of))
        both = current(own.where(~F.col("a").isin(many)), False).unionByName(current(own.where(F.col("a").isin(many)), True))
        values = both.groupBy("e", "a").agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias("v"))
        for t in self.catalog.tables.values():
            if t.key is not None:
                pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.col(f"`{c}`").cast("string").alias("v")) for a, c in t.attributes().items()])
                own = t.rows(True).select(F.col(t.entity).cast(self.store.entity).alias("e"), F.explode(pairs).alias("x"))
                values = values.unionByName(own.select("e", "x.a", "x.v").where("v IS NOT NULL"))
        return values.groupBy("e").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("a", "v")))).alias("attributes"))

    def pull(self, ids: object, pattern: object, as_of: Mapping[str, object] | None = None) -> DataFrame:
        """``id, pulled`` of entities: a DataFrame with the column ``id``, an id or several."""
        if not isinstance(ids, DataFrame):
            many = ids if isinstance(ids, (list, tuple, set)) else [ids]
            ids = self.spark.createDataFrame([(x,) for x in many], f"id {self.store.entity}")
        return pulling.pull(self, ids.select("id").distinct(), pattern, as_of or {})

    # -- reading

    def query(self, form: object, rules: object = None, inputs: Mapping[str, object] | None = None, as_of: Mapping | None = None, names: Iterable[str] | None = None) -> DataFrame:
        """Run a query: EDN text, its data, or :class:`Query`. ``inputs``: values of ``:in`` variables; ``names``: of the result's columns."""
        q = ast.parse(form)
        if q.inputs:
            q = ast.with_inputs(q, {(k if k.startswith("?") else f"?{k}"): v for k, v in (inputs or {}).items()})
        return self.planner(q, rules, as_of).run(q, names)

    def planner(self, q: Query, rules: object = None, as_of: Mapping | None = None) -> Planner:
        times = {**q.as_of, **(as_of or {})}
        self.dimensions.require(d for d in times if d != ":tx")
        return Planner(self.spark, self, ast.parse_rules(rules), times)

    def entity(self, e: object, as_of: object = None) -> dict | None:
        """An entity's attributes now, as of a transaction number, or as of an instant of system time; None if there are none."""
        if isinstance(self.store, MemoryStore):
            facts = {a: self.store.by_key[e, a] for a in self.store.entity_attributes(e)}
        else:
            facts = {}
            from .sources.store import fact_of

            for r in self.store.scan().where(F.col("e") == e).collect():  # one entity's facts
                facts.setdefault(r["a"], []).append(fact_of(r))
        out: dict = {}
        for a, fs in facts.items():
            if isinstance(as_of, datetime):
                fs = [f for f in fs if utc(f.t) <= utc(as_of)]
            elif as_of is not None:
                fs = [f for f in fs if f.tx_id <= as_of]
            single = not self.many.get(a, any(f.many for f in fs))
            if held := holding(fs, not single):
                out[a] = held[0] if single or len(held) == 1 and not self.many.get(a) and not any(f.many for f in fs) else frozenset(held)
        return {":db/id": e, **out} if out else None

    def entity_by(self, a: str, v: object, as_of: object = None) -> dict | None:
        """The first entity of which ``a`` is ``v`` now, as of a time."""
        try:
            e = Transactor(self.store, self._next_id, self.many).look_up((a, v))
        except TransactionError:
            return None
        return self.entity(e, as_of)

    def exists(self, e: object, a: str, v: object) -> bool:
        """Whether an entity's attribute has a value now."""
        return v in holding(self.store.of([(e, a)])[e, a], not self._single(a))

    def list_dimensions(self) -> list:
        """The time dimensions, system time among them, by name."""
        return self.dimensions.listed()

    def subscribe(self, query: object, **options: object):
        """A standing query; see :class:`factlake.streaming.subscription.Subscription`."""
        from .streaming.subscription import Subscription

        with self.lock:
            s = Subscription(self, query, **options)
            self.subscriptions.append(s)
            s.start()
        return s


def entity_id_by(db: Database, a: str, v: object) -> object:
    m = db.entity_by(a, v)
    return m[":db/id"] if m else None


def contains_delta(deltas: Iterable[Delta], **wanted: object) -> bool:
    """Whether some delta has all the given fields."""
    return any(all(getattr(d, k) == v for k, v in wanted.items()) for d in deltas)

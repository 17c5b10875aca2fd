"""Queries maintained from changes: the change of a join is a sum of joins with one changed side.

For patterns P1 ... Pn: d(P1 * ... * Pn) = sum over i of P1' * ... * P(i-1)' * dPi * P(i+1) * ... * Pn, where ' is the new state.
Patterns are sets: only facts that appear or disappear go on, and so each binding is there once. Counts, sums and averages are
sums of signed values; other aggregates are computed again for touched groups only. Everything else (negation, disjunction, rules, closure) is
computed again when an attribute that it reads has changed, and compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.aggregates import AGGREGATES
from ..plans.ast import Agg, Bind, Const, Pattern, Pred, Query, QueryError, Var, variables
from ..plans.planner import _equals, _result_names, column_name, constant
from ..storage import shared_dir
from .zset import MULT, ZSet, merged, transitions


def supported(q: Query) -> bool:
    """Patterns, predicates, and variables or aggregates to find."""
    plain = all(isinstance(c, (Pred, Bind)) or (isinstance(c, Pattern) and not c.closure and not c.at) for c in q.where)
    return plain and any(isinstance(c, Pattern) for c in q.where) and all(isinstance(x, (Var, Agg)) for x in q.find) and not q.as_of


#: Rows of a change up to which it stays with the driver; larger ones are written. Written changes of a state before they join its base.
SMALL, PARTS = 5_000, 16
#: Keys of a change up to which they filter the scan of a state.
FEW = 1_000


@dataclass(frozen=True)
class Part:
    """Rows of a state: written in a folder (``path``), or, few as they are, with the driver."""

    df: DataFrame
    path: str | None = None
    rows: int | None = None
    table: pa.Table | None = None

    @classmethod
    def written(cls, df: DataFrame) -> Part:
        path = shared_dir(df.sparkSession)
        df.write.parquet(path)
        return cls.at(df.sparkSession, path, df.schema)

    @classmethod
    def at(cls, spark: SparkSession, path: str, schema: object = None) -> Part:
        return cls((spark.read.schema(schema) if schema else spark.read).parquet(path), path)

    @classmethod
    def of(cls, df: DataFrame, large: bool = False) -> Part:
        if not large:
            rows = df.limit(SMALL + 1).toArrow()  # bounded
            if len(rows) <= SMALL:
                return cls.local(df.sparkSession, rows, df.schema)
        return cls.written(df)

    def fetched(self) -> Part:
        """With the driver, if it has few rows."""
        rows = self.df.limit(SMALL + 1).toArrow() if self.path else None  # bounded
        return self if rows is None or len(rows) > SMALL else Part.local(self.df.sparkSession, rows, self.df.schema)

    @classmethod
    def local(cls, spark: SparkSession, rows: pa.Table, schema: object) -> Part:
        """Rows of the driver; a frame that is made from Arrow has a size that the planner knows."""
        return cls(spark.createDataFrame(rows, schema), None, len(rows), rows)

    @classmethod
    def summed(cls, df: DataFrame, sums: Sequence[str] = (MULT,), large: bool = False) -> Part:
        """The sums of the rows that are equal but for these columns, without those whose ``mult`` is 0; few rows are summed by the driver."""
        keys = [c for c in df.columns if c not in sums]
        if not large:
            rows = df.limit(SMALL + 1).toArrow()  # bounded
            if len(rows) <= SMALL:
                got = rows.group_by(keys).aggregate([(c, "sum") for c in sums])
                got = pa.table({c: got.column(c if c in keys else f"{c}_sum").cast(rows.schema.field(c).type) for c in df.columns})
                if MULT in sums:
                    got = got.filter(pc.not_equal(got.column(MULT), 0))
                return cls.local(df.sparkSession, got, df.schema)
        out = df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(*[F.sum(c).cast(df.schema[c].dataType).alias(c) for c in sums])
        out = (out.where(f"{MULT} <> 0") if MULT in sums else out).select(*[F.col(f"`{c}`") for c in df.columns])
        return cls.written(out.sortWithinPartitions(F.col(f"`{keys[0]}`")) if keys else out)  # so that few keys read few row groups


class Log:
    """A state as a base and the changes since. Rows are additive: what counts is their sum, so nothing is rewritten when one comes."""

    def __init__(self) -> None:
        self.parts: list[Part] = []

    def __bool__(self) -> bool:
        return bool(self.parts)

    def frames(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [x.df for x in self.parts])

    def add(self, part: Part, sums: Sequence[str] = (MULT,)) -> None:
        """Append a change. What the driver holds is one part, until it is large enough to be written; many written parts become one."""
        if part.rows == 0 and self.parts:
            return
        small = [x for x in self.parts if x.path is None]
        if part.path is None and small:
            rows = pa.concat_tables([*(x.table for x in small), part.table.cast(small[0].table.schema)])
            joined = Part.local(part.df.sparkSession, rows, part.df.schema)
            self.parts = [x for x in self.parts if x.path] + [joined if joined.rows <= 4 * SMALL else Part.summed(joined.df, sums, True)]
        else:
            self.parts = [*self.parts, part]
        if len(self.parts) > PARTS:
            self.parts = [Part.summed(self.frames(), sums, True)]

    def some(self, table: pa.Table | None, cols: list[str]) -> DataFrame:
        """All rows, or, where the driver knows a few keys of a column, no more than have one of them."""
        for c in cols if table is not None and len(table) <= FEW else ():
            values = pc.unique(table.column(c)).to_pylist()
            if values and all(type(v) is int for v in values):
                among = f"`{c}` IN ({', '.join(map(str, values))})"
                return reduce(DataFrame.unionByName, [x.df if x.path is None else x.df.where(among) for x in self.parts])
        return self.frames()

    def near(self, keys: DataFrame, cols: list[str], table: pa.Table | None = None) -> DataFrame:
        """The rows whose ``cols`` are among the keys' (null equals null); all without ``cols``."""
        own = self.some(table, cols)
        if not cols:
            return own
        return own.alias("s").join(keys.select(*[F.col(f"`{c}`") for c in cols]).alias("k"), _same("s", "k", cols), "left_semi")

    def saved(self) -> list[str]:
        """Folders that hold the state; what the driver held is written."""
        self.parts = [x if x.path else Part.written(x.df) for x in self.parts]
        return [x.path for x in self.parts]


def _same(a: str, b: str, cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in cols])


def _summed(df: DataFrame) -> DataFrame:
    return ZSet(df).consolidate().df


class LiveView:
    """A query's result, maintained. ``apply`` takes the signed changes of attributes and gives the result's.

    Each pattern's relation, the groups or the result are kept as a base and the changes since (:class:`Log`). A batch reads
    what it joins with and appends its own rows; it rewrites nothing but, now and then, a base that many changes have joined.
    """

    def __init__(self, query: Query, names: Iterable[str] | None = None):
        if not supported(query):
            raise QueryError("this query is maintained by computing it again")
        self.query = query
        self.names = list(names or query.names or _result_names(query.find))
        self.patterns = [c for c in query.where if isinstance(c, Pattern)]
        self.filters = [c for c in query.where if not isinstance(c, Pattern)]
        self.linear = query.aggregates and all(AGGREGATES[x.fn].linear for x in query.find if isinstance(x, Agg))
        self.state = {**{f"pattern{i}": Log() for i in range(len(self.patterns))}, "bindings": Log(), "groups": Log(), "result": Log()}

    def _bound(self, p: Pattern, change: DataFrame) -> ZSet:
        """An attribute's changes (``e, v, mult``) as changes of the pattern's bindings."""
        cond, bound = F.lit(True), {}
        for x, c in ((p.e, "e"), (p.v, "v")):
            if isinstance(x, Const):
                cond &= _equals(x.value, change, c)
            elif isinstance(x, Var):
                if x in bound:
                    cond &= scalar.call("=", [(F.col(y), change.schema[y].dataType) for y in (c, bound[x])])[0]
                else:
                    bound[x] = c
        return ZSet(change.where(cond).select(*[F.col(c).alias(column_name(v)) for v, c in bound.items()], MULT))

    def _filtered(self, z: ZSet) -> ZSet:
        todo = list(self.filters)
        df = z.df
        while todo:
            ready = [c for c in todo if all(not isinstance(a, Var) or column_name(a) in df.columns for a in c.args)]
            if not ready:
                raise QueryError("a predicate's variables are not bound")
            for c in ready:
                args = [(F.col(f"`{column_name(a)}`"), df.schema[column_name(a)].dataType) if isinstance(a, Var) else constant(a.value) for a in c.args]
                value = scalar.call(c.fn, args)
                if isinstance(c, Pred):
                    df = df.where(scalar.truthy(value))
                elif column_name(c.out) in df.columns:
                    df = df.where(scalar.call("=", [(F.col(f"`{column_name(c.out)}`"), df.schema[column_name(c.out)].dataType), value])[0])
                else:
                    df = df.withColumn(column_name(c.out), value[0])
                    df = df.where(scalar.truthy((F.col(f"`{column_name(c.out)}`"), value[1]))) if c.truthy else df
                todo.remove(c)
        return ZSet(df)

    def apply(self, changes: Mapping[str, DataFrame], exact: bool = False) -> ZSet:
        """Apply a batch: for each attribute ``e, v, mult``. Every attribute of the query must be in the first batch, if only for its types.

        ``exact``: the changes are of a set, +1 for a fact that wasn't there and -1 for one that was, as a database's deltas
        are; otherwise facts may come several times, and the state tells which of them appear or disappear.
        """
        logs = [self.state[f"pattern{i}"] for i in range(len(self.patterns))]
        if any(not o and p.a not in changes for o, p in zip(logs, self.patterns, strict=True)):
            raise QueryError("the first batch must have every attribute of the query")
        first = not all(logs)
        deltas = [Part.summed(self._bound(p, changes[p.a]).df, large=first) if p.a in changes else None for p in self.patterns]
        large = first or any(d is not None and d.path for d in deltas)  # then nothing is looked up: a state and a change meet in one grouping
        old = [list(o.parts) for o in logs]
        for o, d in zip(logs, deltas, strict=True):
            if d is not None:
                o.parts = [*o.parts, d]
        total: ZSet | None = None
        for i, d in enumerate(deltas):
            if d is None or d.rows == 0 and total is not None or any(not x for x in old[i + 1 :]):
                continue  # beside a side without an old state there is nothing to meet
            sides = {}
            for j in range(len(logs)):
                if j != i:
                    sides[j] = Log()
                    sides[j].parts = logs[j].parts if j < i else old[j]
            term = ZSet(d.df) if exact or len(self.patterns) == 0 else self._moved(old[i], d, large)
            while sides:  # along shared variables first
                j = next((k for k in sides if set(self._columns(k)) & set(term.columns)), next(iter(sides)))
                cols = [c for c in self._columns(j) if c in term.columns]
                own = sides.pop(j)
                table = d.table if d.table is not None and set(cols) <= set(d.table.column_names) else None
                near = own.some(table, cols) if large or exact else own.near(term.df, cols, table)
                term = term.join(ZSet(near) if exact else ZSet(near).distinct())
            total = term if total is None else total + term
        if total is None:
            raise QueryError("nothing changed")
        moved = Part.summed(self._filtered(total).df, large=large)
        for o, parts, d in zip(logs, old, deltas, strict=True):
            o.parts = parts
            if d is not None:
                o.add(d)
        return ZSet((self._grouped(moved, large) if self.linear else self._touched(moved, large) if self.query.aggregates else self._projected(moved, large)).df)

    def _columns(self, i: int) -> list[str]:
        p = self.patterns[i]
        return list(dict.fromkeys(column_name(x) for x in (p.e, p.v) if isinstance(x, Var)))

    def _moved(self, old: list[Part], d: Part, large: bool) -> ZSet:
        """Which facts of a change appear or disappear."""
        if not old:
            return ZSet(d.df).distinct()
        log = Log()
        log.parts = old
        if large:
            return merged(ZSet(log.frames()), ZSet(d.df))
        cols = [c for c in d.df.columns if c != MULT]
        return transitions(ZSet(_summed(log.near(d.df, cols))), ZSet(d.df))[0]

    def _projected(self, moved: Part, large: bool) -> Part:
        cols = [F.col(f"`{column_name(x)}`").alias(n) for x, n in zip(self.query.find, self.names, strict=True)]
        change, result = ZSet(moved.df).map(*cols), self.state["result"]
        bound = {column_name(v) for c in self.query.where for v in variables(c)}
        if {column_name(x) for x in self.query.find} >= bound:  # a binding is a row
            kept = out = Part.of(change.df, large)
        else:
            kept = Part.summed(change.df, large=large)
            if large and result:
                out = Part.written(merged(ZSet(result.frames()), ZSet(kept.df)).df)
            else:
                before = ZSet(_summed(result.near(kept.df, self.names, kept.table)) if result else kept.df.limit(0))
                out = Part.of(transitions(before, ZSet(kept.df))[0].df, large)
        result.add(kept)
        return out

    def _groups(self) -> list[tuple[str, str]]:
        return [(column_name(x), n) for x, n in zip(self.query.find, self.names, strict=True) if isinstance(x, Var)]

    def _final(self, prefix: str) -> list[Column]:
        """The result's columns from a group's number of bindings and signed sums."""
        out, i = [], 0
        for x, n in zip(self.query.find, self.names, strict=True):
            if isinstance(x, Var):
                out.append(F.col(f"`{n}`"))
                continue
            s, k = f"{prefix}s{i}", f"{prefix}k{i}"
            out.append((F.col(f"{prefix}n") if x.fn == "count" else F.coalesce(s, F.lit(0)) if x.fn == "sum" else F.coalesce(F.try_divide(s, k), F.lit(0.0))).alias(n))
            i += 1
        return out

    def _grouped(self, moved: Part, large: bool) -> Part:
        """Linear aggregates: each group's sums are added to."""
        groups, log = self._groups(), self.state["groups"]
        aggs = [x for x in self.query.find if isinstance(x, Agg)]
        sums = {"__n": F.col(MULT)}
        for i, x in enumerate(aggs):
            if x.fn != "count":
                there = F.col(f"`{column_name(x.arg)}`").isNotNull()
                sums[f"__s{i}"] = F.when(there, F.col(f"`{column_name(x.arg)}`") * F.col(MULT)).otherwise(0)
                sums[f"__k{i}"] = F.when(there, F.col(MULT)).otherwise(0)
        names, all_sums = [n for _, n in groups], list(sums)
        keys = [F.col(f"`{c}`").alias(n) for c, n in groups]
        if groups:
            delta = Part.summed(moved.df.select(*keys, *[c.alias(n) for n, c in sums.items()]), all_sums, large).fetched()
        else:
            delta = Part.of(moved.df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]))
        touched = delta.df.select(*[F.col(f"`{n}`") for n in names])
        old = Part.summed(log.near(touched, names, delta.table), all_sums, delta.path is not None) if log else None
        had = bool(log)
        log.add(delta, all_sums)
        one = lambda df: ZSet.of((df.where("__n <> 0") if names else df).select(*self._final("__")))
        if not had:
            return Part(one(delta.df).df)
        now = Part.summed(old.df.unionByName(delta.df), all_sums, delta.path is not None)
        return Part.summed((one(now.df) - one(old.df)).df, large=delta.path is not None)

    def _touched(self, moved: Part, large: bool) -> Part:
        """Other aggregates: again from the bindings of groups that changed."""
        groups, log, result = self._groups(), self.state["bindings"], self.state["result"]
        log.add(moved)
        own = [c for c, _ in groups]
        keys = Part.of(moved.df.select(*[F.col(f"`{c}`") for c in own]).distinct()) if large and groups else moved
        now = ZSet(log.near(keys.df, own, keys.table)).consolidate().df.where(f"{MULT} > 0")
        made = []
        for x, n in zip(self.query.find, self.names, strict=True):
            if isinstance(x, Agg):
                c, t = (F.lit(1), None) if x.fn == "count" else (F.col(f"`{column_name(x.arg)}`"), now.schema[column_name(x.arg)].dataType)
                made.append(AGGREGATES[x.fn].make(c, t, *x.params).alias(n))
        out = now.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in groups]).agg(*made) if groups else now.agg(*made)
        new = ZSet(Part.of(ZSet.of(out.select(*[F.col(f"`{n}`") for n in self.names])).df, keys.path is not None).df)
        if result:
            names = [n for _, n in groups]
            gone = result.near(keys.df.select(*[F.col(f"`{c}`").alias(n) for c, n in groups]), names)
            new = new - ZSet(gone)
        change = Part.summed(new.df, large=keys.path is not None)
        result.add(change)
        return change

    def result(self) -> DataFrame:
        """The result as it is now."""
        if self.linear and self.state["groups"]:
            names = [n for _, n in self._groups()]
            own = self.state["groups"].frames()
            own = own.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*[F.sum(c).alias(c) for c in own.columns if c not in names])
            return (own.where("__n <> 0") if names else own).select(*self._final("__"))
        if not self.state["result"]:
            raise QueryError("no batch was applied")
        return _summed(self.state["result"].frames()).where(f"{MULT} > 0").select(*[F.col(f"`{n}`") for n in self.names])

    def save(self) -> dict[str, list[str]]:
        """Folders that hold the state, to give to :meth:`load`."""
        return {k: log.saved() for k, log in self.state.items()}

    def load(self, spark: SparkSession, saved: Mapping[str, list[str]]) -> None:
        for k, paths in saved.items():
            self.state[k].parts = [Part.at(spark, p) for p in paths]


def attributes(clauses: Iterable, rules: Mapping[str, list] | None = None) -> set[str]:
    """Attributes that clauses read; with rules, all that any rule mentions."""
    out: set[str] = set()

    def look(x: object) -> None:
        if isinstance(x, Pattern):
            out.add(x.a)
        for name in ("clauses", "branches"):
            for y in getattr(x, name, ()):
                for z in y if isinstance(y, tuple) else (y,):
                    look(z)

    def words(x: object) -> None:
        if isinstance(x, list):
            for y in x:
                words(y)
        elif isinstance(x, str) and x.startswith(":"):
            out.add(x.removesuffix("+"))

    for c in clauses:
        look(c)
    for defs in (rules or {}).values():
        for _, body in defs:
            words(body)
    return out



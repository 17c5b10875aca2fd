"""Standing queries: a transaction's effect on a result, delivered as additions and retractions."""

from __future__ import annotations

import queue
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Row

from ..operators.temporal import SYSTEM
from ..plans import ast
from .live import LiveView, attributes, supported
from .zset import ZSet

if TYPE_CHECKING:
    from ..db import Database


#: Kinds of values that a maintained view takes.
PLAIN = {"long", "double", "string", "boolean", "instant"}


@dataclass(frozen=True)
class Diff:
    additions: frozenset
    retractions: frozenset

    def __bool__(self) -> bool:
        return bool(self.additions or self.retractions)


def _value(x: object) -> object:
    if isinstance(x, Row):
        return tuple(map(_value, x))
    if isinstance(x, list):
        return tuple(map(_value, x))
    if isinstance(x, dict):
        return tuple(sorted((k, _value(v)) for k, v in x.items()))
    return x


class Subscription:
    """A query whose result is delivered now (as additions) and then whenever transactions change it.

    ``callback`` gets each :class:`Diff`, or ``delivery="queue"`` puts them into ``queue``, which holds ``maxsize`` and makes
    transactions wait when it is full. ``watch_dimensions``: only transactions with one of these time dimensions are delivered,
    even if they change nothing; others still count. ``transform`` maps each diff before it is delivered. A transaction that
    touches no attribute of the query costs nothing. Joins, filters and aggregates over facts with plain values are carried on
    by a transaction's deltas (:class:`LiveView`); other queries are computed again.
    """

    def __init__(self, db: Database, query: object, callback: Callable[[Diff], None] | None = None, rules: object = None, delivery: str = "callback", watch_dimensions: Iterable[str] = (), transform: Callable[[Diff], object] | None = None, maxsize: int = 100):
        if delivery not in ("callback", "queue"):
            raise ValueError(f"unknown delivery {delivery}")
        if delivery == "callback" and callback is None:
            raise ValueError("delivery by callback needs one")
        self.db, self.query, self.rules = db, ast.parse(query), rules
        self.callback, self.transform = callback, transform
        self.queue: queue.Queue | None = queue.Queue(maxsize) if delivery == "queue" else None
        self.watch = {d for d in watch_dimensions if d != SYSTEM}
        self.reads = attributes(self.query.where, ast.parse_rules(rules)) | _pulled(self.query)
        self.active, self.rows = True, frozenset()

    def _maintained(self) -> LiveView | None:
        """A view of the result that starts from the database, if the query has one: patterns over facts with plain values."""
        kinds = self.db.store.attributes()
        own = sorted(self.reads)
        if not supported(self.query) or self.query.inputs or any(self.db.column(a) or len(kinds.get(a, (set(), False))[0]) != 1 or not kinds[a][0] <= PLAIN for a in own):
            return None
        self.kinds = {a: (set(kinds[a][0]), self.db._single(a)) for a in own}
        facts = {a: self.db.facts(a, {})[0] for a in own}
        view = LiveView(self.query)
        view.apply({a: ZSet.of(df).df for a, df in facts.items()}, exact=True)
        self.schemas = {a: ZSet.of(df).df.schema for a, df in facts.items()}
        return view

    def _changed(self, deltas: list) -> bool:
        """Carry the result on by a transaction's deltas; False if it must be computed again."""
        kinds = self.db.store.attributes()
        if self.view is None or any((set(kinds[a][0]), self.db._single(a)) != k for a, k in self.kinds.items()):
            return False
        changes: dict[str, Counter] = {}
        for d in deltas:
            if d.attribute in self.kinds:
                own = changes.setdefault(d.attribute, Counter())
                own.update({(d.entity, v): 1 for v in d.asserted})
                own.subtract({(d.entity, v): 1 for v in d.retracted})
        spark = self.db.spark
        frames = {a: spark.createDataFrame([(*k, n) for k, n in c.items() if n], self.schemas[a]) for a, c in changes.items()}
        for r in self.view.apply(frames, exact=True).df.collect():  # the change of a result that is the consumer's
            row = tuple(map(_value, r[:-1]))
            self.rows = self.rows | {row} if r[-1] > 0 else self.rows - {row}
        return True

    def start(self) -> None:
        self._again()
        self._deliver(Diff(self.rows, frozenset()))

    def _again(self) -> None:
        self.view = self._maintained()
        own = self.view.result().collect() if self.view else self.db.query(self.query, self.rules).collect()  # a standing query's result is its consumer's
        self.rows = frozenset(tuple(map(_value, r)) for r in own)

    def _deliver(self, diff: Diff) -> None:
        out = self.transform(diff) if self.transform else diff
        if self.queue is not None:
            self.queue.put(out)
        else:
            self.callback(out)

    def on_transaction(self, deltas: list, dims: Mapping[str, object]) -> None:
        if not self.active:
            return
        before = self.rows
        if any(d.attribute in self.reads for d in deltas) or ":*" in self.reads:
            if not self._changed(deltas):
                self._again()
        diff = Diff(self.rows - before, before - self.rows)
        watched = bool(self.watch & set(dims))
        if (diff and not self.watch) or watched:
            self._deliver(diff)

    def results(self) -> frozenset:
        return self.rows

    def stop(self) -> None:
        """End the subscription; nothing is delivered any more."""
        self.active = False
        if self in self.db.subscriptions:
            self.db.subscriptions.remove(self)


def _pulled(q: ast.Query) -> set[str]:
    return {":*"} if any(isinstance(x, ast.Pull) for x in q.find) else set()

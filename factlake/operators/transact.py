"""Transactions: from maps, operations and references to facts and deltas."""

from __future__ import annotations

import itertools
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from ..plans import edn
from ..sources.store import Fact
from .temporal import holding, utc


class TransactionError(ValueError):
    """A transaction that was not applied, with the reason."""


OPERATIONS = (":db/add", ":db/retract", ":db/assoc", ":db/conj")


@dataclass(frozen=True)
class Delta:
    """What a transaction did to an entity's attribute. ``asserted``, ``retracted``: the single values that came and went."""

    entity: object
    attribute: str
    old_value: object
    new_value: object
    operation: str
    tx: dict = field(hash=False)
    dims: dict = field(default_factory=dict, hash=False)
    asserted: tuple = ()
    retracted: tuple = ()

    @property
    def changed(self) -> bool:
        return self.old_value != self.new_value


@dataclass(frozen=True)
class Op:
    kind: str
    e: object
    a: str
    v: object
    k: object = None


@dataclass(frozen=True)
class _Auto:
    """The entity of a map without an id; apart from the numbers that users write."""

    n: int


def _is_ref(x: object) -> bool:
    return isinstance(x, (list, tuple)) and len(x) == 2 and isinstance(x[0], str) and x[0].startswith(":")


def operations(data: object) -> list[Op]:
    """Maps and lists as single operations."""
    auto, out = itertools.count(1), []
    for x in data:
        if isinstance(x, Mapping):
            e = x.get(":db/id")
            e = _Auto(next(auto)) if e is None else e
            own = [(a, v) for a, v in x.items() if a != ":db/id"]
            if not own:
                raise TransactionError(f"nothing to say about {e}")
            out += [Op(":db/add", e, str(a), v) for a, v in own]
            continue
        kind, *rest = x
        if kind not in OPERATIONS:
            raise TransactionError(f"unknown operation {kind}")
        n = {":db/assoc": 4, ":db/retract": (2, 3)}.get(kind, 3)
        if len(rest) not in (n if isinstance(n, tuple) else (n,)):
            raise TransactionError(f"{kind} with {len(rest)} arguments")
        if kind == ":db/assoc":
            out.append(Op(kind, rest[0], str(rest[1]), rest[3], rest[2]))
        else:
            out.append(Op(kind, rest[0], str(rest[1]), rest[2] if len(rest) > 2 else None))
    return out


def _plain(v: object) -> object:
    """Values as they are stored: keywords and symbols as text, instants with a zone, sets of hashable values."""
    if isinstance(v, str):
        return str(v)
    if isinstance(v, datetime):
        return utc(v)
    if isinstance(v, (set, frozenset)):
        return frozenset(_plain(x) for x in v)
    if isinstance(v, Mapping):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


class Transactor:
    """Turns one transaction's operations into facts against the state before it."""

    def __init__(self, store: object, next_id: object, declared: Mapping[str, bool]):
        self.store, self.next_id, self.declared = store, next_id, declared

    def entity(self, e: object, temp: dict) -> object:
        if isinstance(e, _Auto) or (isinstance(e, int) and not isinstance(e, bool) and e < 0):
            if e not in temp:
                temp[e] = self.next_id(None)
            return temp[e]
        if _is_ref(e):
            return self.look_up(e)
        if isinstance(e, bool) or not isinstance(e, (int, str)):
            raise TransactionError(f"{e!r} is no entity")
        return self.next_id(e)

    def look_up(self, ref: object) -> object:
        a, v = ref[0], _plain(ref[1])
        found = self.store.first(a, v, self.many(a))
        if found is None:
            raise TransactionError(f"Lookup ref not found: [{a} {v!r}]")
        return found

    def many(self, a: str) -> bool:
        if a in self.declared:
            return self.declared[a]
        return self.store.attributes().get(a, (set(), False))[1]

    def value(self, v: object, temp: dict) -> object:
        if isinstance(v, int) and not isinstance(v, bool) and v in temp:
            return temp[v]
        if isinstance(v, (set, frozenset)):
            return frozenset(self.value(x, temp) for x in v)
        return self.look_up(v) if _is_ref(v) else _plain(v)

    def run(self, ops: list[Op], tx: dict, dims: Mapping[str, object]) -> tuple[list[Fact], list[Delta]]:
        temp: dict = {}
        ops = [Op(o.kind, self.entity(o.e, temp), o.a, o.v, o.k) for o in ops]  # all ids first: references may look ahead
        ops = [Op(o.kind, o.e, o.a, self.value(o.v, temp), o.k) for o in ops]
        before = self.store.of({(o.e, o.a) for o in ops})
        scalar: dict[tuple, set] = {}
        for o in ops:
            if o.kind == ":db/add" and not isinstance(o.v, (list, dict, frozenset)):
                scalar.setdefault((o.e, o.a), set()).add(o.v)
        facts: list[Fact] = []
        deltas: list[Delta] = []
        for o in ops:
            many = self.many(o.a) or isinstance(o.v, frozenset) or len(scalar.get((o.e, o.a), ())) > 1
            held = holding(before[o.e, o.a], self.many(o.a))
            old = frozenset(held) if self.many(o.a) and held else held[0] if held else None
            new, put, gone = self._apply(o, held, old, many)
            if put and not self.many(o.a) and not isinstance(o.v, frozenset):
                gone = [v for v in held if v not in put]  # what is replaced ends, whatever the attribute holds later
            for v in gone:
                facts.append(Fact(o.e, o.a, v, tx[":tx/id"], len(facts), tx[":tx/time"], "retract", dict(dims), many))
            for v in put:
                facts.append(Fact(o.e, o.a, v, tx[":tx/id"], len(facts), tx[":tx/time"], "assert", dict(dims), many))
            if put or gone:
                deltas.append(Delta(o.e, o.a, old, new, ":retract" if o.kind == ":db/retract" else ":assert", tx, dict(dims), tuple(v for v in put if v not in held), tuple(gone)))
        return facts, deltas

    def _apply(self, o: Op, held: list, old: object, many: bool) -> tuple[object, list, list]:
        """The new value, and the single values that are asserted and retracted."""
        if o.kind == ":db/retract":
            wanted = list(o.v) if isinstance(o.v, frozenset) else [o.v]
            gone = list(held) if o.v is None else [v for v in held if v in wanted]
            left = [v for v in held if v not in gone]
            return (frozenset(left) if many and left else left[0] if left else None), [], gone
        if o.kind == ":db/assoc":
            if held and not isinstance(held[0], dict):
                raise TransactionError(f"{o.a} is not a map")
            new = {**(held[0] if held else {}), str(o.k): o.v}
            return new, [new], []
        if o.kind == ":db/conj":
            if many:
                return frozenset([*held, o.v]), [o.v], []
            if held and not isinstance(held[0], list):
                raise TransactionError(f"{o.a} is not a vector")
            new = [*(held[0] if held else []), o.v]
            return new, [new], []
        if isinstance(o.v, frozenset):
            return frozenset([*held, *o.v]), sorted(o.v, key=str), []
        if isinstance(o.v, dict) and held and isinstance(held[0], dict):
            new = {**held[0], **o.v}
            return new, [new], []
        if isinstance(o.v, (list, dict)):
            return o.v, [o.v], []
        if held and isinstance(held[0], list) and not many:
            new = [*held[0], o.v]
            return new, [new], []
        return (frozenset([*held, o.v]) if many and self.many(o.a) else o.v), [o.v], []


def read(data: object) -> tuple[list, dict, dict]:
    """Transaction data, its metadata and time dimensions."""
    if isinstance(data, str):
        data = edn.read(data)
    if isinstance(data, Mapping) and ":tx-data" in data:
        return list(data[":tx-data"]), dict(data.get(":tx-meta") or {}), dict(data.get(":time-dimensions") or {})
    if isinstance(data, Mapping):
        raise TransactionError("a map needs :tx-data")
    return list(data), {}, {}

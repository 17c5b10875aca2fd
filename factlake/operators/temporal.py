"""Facts as of given times: filters, the latest value, time dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import KINDS, Fact

SYSTEM = ":time/system"


class TimeError(ValueError):
    """A time dimension that isn't there, or a transaction that breaks a constraint."""


@dataclass
class Dimension:
    name: str
    kind: str = ":instant"
    indexed: bool = False
    constraints: list = field(default_factory=list)
    derived: dict | None = None
    description: str | None = None


class Dimensions:
    """The time dimensions of a database."""

    def __init__(self) -> None:
        self.known: dict[str, Dimension] = {SYSTEM: Dimension(SYSTEM)}

    def define(self, m: Mapping) -> None:
        """From an entity with ``:dimension/name`` and its further attributes."""
        name = m[":dimension/name"]
        self.known[name] = Dimension(name, m.get(":dimension/type", ":instant"), bool(m.get(":dimension/indexed?")), list(m.get(":dimension/constraints") or ()), m.get(":dimension/derived-from"), m.get(":dimension/description"))

    def listed(self) -> list[Dimension]:
        """All dimensions by name."""
        return [self.known[d] for d in sorted(self.known)]

    def moment(self, name: str) -> Column:
        """A fact's time in a dimension, or a derived dimension's milliseconds."""
        if name == SYSTEM:
            return F.col("t")
        return F.col("nums" if name in self.known and self.known[name].derived else "dims")[name]

    def require(self, names: Iterable[str]) -> None:
        for n in names:
            if n not in self.known:
                raise TimeError(f"unknown time dimension {n}")

    def complete(self, dims: Mapping[str, object], now: datetime, entities: Iterable[object], before: Callable[[list], Mapping[object, Mapping[str, object]]]) -> dict[str, object]:
        """A transaction's dimensions with system time and derived ones; checks every constraint for every entity of the transaction.

        ``before`` gives the times that entities have in the log; it is asked only if some constraint or derived dimension needs them.
        """
        if SYSTEM in dims:
            raise TimeError(f"{SYSTEM} cannot be set")
        self.require(d for d in dims if d != ":fn" and not callable(dims[d]))
        check = dims.get(":fn")
        own = {d: utc(v) for d, v in dims.items() if d != ":fn"}
        entities = list(entities)
        asked = callable(check) or any(d.constraints or d.derived for d in self.known.values())
        had = before(entities) if asked and entities else {}
        for e in entities:
            merged = {**had.get(e, {}), **own}
            for d in merged:
                for c in self.known[d].constraints if d in self.known else ():
                    if c.get(":type") == ":ordering" and (after := merged.get(c[":after"])) is not None and merged[d] < after:
                        raise TimeError(f"{d} is before {c[':after']}")
                    if callable(c.get(":fn")) and not c[":fn"](merged):
                        raise TimeError(f"a constraint of {d} does not hold")
            if callable(check) and not check(merged):
                raise TimeError("the transaction's constraint does not hold")
        out = {**own, SYSTEM: now}
        for e in entities[:1] or [None]:
            merged = {**had.get(e, {}), **own}
            for d in self.known.values():
                if d.derived and d.derived.get(":op") == ":minus":
                    a, b = (merged.get(x) for x in d.derived[":operands"])
                    if isinstance(a, datetime) and isinstance(b, datetime):
                        out[d.name] = millis(a) - millis(b)
        return out


def utc(v: object) -> object:
    if isinstance(v, datetime):
        return v if v.tzinfo else v.replace(tzinfo=timezone.utc)
    return v


def millis(d: datetime) -> int:
    delta = utc(d) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400_000_000 + delta.seconds * 1_000_000 + delta.microseconds) // 1000


def as_of_filter(as_of: Mapping[str, object]) -> Column:
    """Facts that had been recorded (system time, transaction) and had happened (dimensions; facts without one pass)."""
    cond = F.lit(True)
    for d, t in as_of.items():
        if d == ":tx":
            cond &= F.col("tx_id") <= t
        elif d == SYSTEM:
            cond &= F.col("t") <= F.lit(utc(t))
        else:
            at = F.col("dims")[d]
            cond &= at.isNull() | (at <= F.lit(utc(t)))
    return cond


def typed_value(kinds: set[str]) -> tuple[Column, str]:
    """The value column of an attribute with facts of these kinds; longs widen to double, other mixtures are an error."""
    kinds = kinds - {"nil"}
    if kinds == {"long", "double"}:
        return F.coalesce("v_double", F.col("v_long").cast("double")), "double"
    if len(kinds) > 1:
        raise TypeError(f"an attribute has values of kinds {sorted(kinds)}")
    kind = next(iter(kinds), "string")
    if kind == "vector":
        return F.from_json("v_json", "array<string>"), "vector"
    return F.col(KINDS[kind]), kind


def current(facts: DataFrame, many: bool, value: Column | None = None) -> DataFrame:
    """The facts that hold, of attributes with one value at a time or with many: ``value`` is the column that tells values apart.

    Single-valued: all assertions of the entity's last transaction (several may be equal in age), without those that a later
    retraction in it names. Many-valued: for each value the newest fact, if it is an assertion. Filters on values belong above.
    """
    if value is None:
        value = F.to_json(F.struct("kind", "v_long", "v_double", "v_string", "v_boolean", "v_instant", "v_json"))
    own = facts
    if not many:
        own = own.withColumn("__rank", F.rank().over(Window.partitionBy("e", "a").orderBy(F.desc("tx_id")))).where("__rank = 1").drop("__rank")
    own = own.withColumn("__v", value)
    newest = F.row_number().over(Window.partitionBy("e", "a", "__v").orderBy(F.desc("tx_id"), F.desc("seq")))
    return own.withColumn("__n", newest).where("__n = 1 AND op = 'assert'").drop("__n", "__v")


def holding(facts: Iterable[Fact], many: bool) -> list[object]:
    """The same rule over some facts of one entity and attribute on the driver: the values that hold, in order of assertion."""
    facts = sorted(facts, key=lambda f: (f.tx_id, f.seq))
    if not facts:
        return []
    if not many:
        facts = [f for f in facts if f.tx_id == facts[-1].tx_id]
    last: dict[str, Fact] = {}
    for f in facts:
        k = repr(f.v)
        last.pop(k, None)
        last[k] = f
    return [f.v for f in last.values() if f.op == "assert"]

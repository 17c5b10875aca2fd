"""The scalar functions of queries as columns.

What fails on a row is false there, as if a predicate had thrown: arithmetic is ``try_*``, comparisons of unlike types are
false, and null never passes a filter. An unknown function is an error before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
SIZED = (T.ArrayType, T.MapType)

#: A column and its type; every function takes and returns such pairs.
Typed = tuple[Column, T.DataType]
_BOOL, _LONG, _DOUBLE, _STRING = T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()


class FunctionError(ValueError):
    """A call that no row could make work."""


def millis(x: Typed) -> Typed:
    """Instants become milliseconds since the epoch, floored; anything else stays."""
    c, t = x
    return (F.unix_millis(c.cast("timestamp")), _LONG) if isinstance(t, TIME) else x


def truthy(x: Typed) -> Column:
    """Everything but null and false."""
    c, t = x
    return F.coalesce(c, F.lit(False)) if isinstance(t, T.BooleanType) else c.isNotNull()


def _kind(t: T.DataType) -> str:
    for name, kinds in (("number", NUMERIC), ("time", TIME), ("string", (T.StringType,)), ("boolean", (T.BooleanType,))):
        if isinstance(t, kinds):
            return name
    return t.simpleString()


def _alike(a: T.DataType, b: T.DataType) -> bool:
    return _kind(a) == _kind(b) or isinstance(a, T.NullType) or isinstance(b, T.NullType)


def _chain(op: Callable[[Column, Column], Column]) -> Callable[..., Typed]:
    def compare(*xs: Typed) -> Typed:
        parts = []
        for (a, ta), (b, tb) in zip(xs, xs[1:], strict=False):
            ordered = _alike(ta, tb) and _kind(ta) in ("number", "string", "void")
            parts.append(F.coalesce(op(a, b), F.lit(False)) if ordered else F.lit(False))
        return reduce(lambda x, y: x & y, parts, F.lit(True)), _BOOL

    return lambda *xs: compare(*map(millis, xs))


def _equal(*xs: Typed) -> Typed:
    xs = tuple(map(millis, xs))
    parts = [a.eqNullSafe(b) if _alike(ta, tb) else F.lit(False) for (a, ta), (b, tb) in zip(xs, xs[1:], strict=False)]
    return reduce(lambda x, y: x & y, parts, F.lit(True)), _BOOL


def _math(name: str, op: Callable[[Column, Column], Column], unit: int, inverse: bool = False) -> Callable[..., Typed]:
    def f(*xs: Typed) -> Typed:
        xs = tuple(map(millis, xs))
        if not all(isinstance(t, (*NUMERIC, T.NullType)) for _, t in xs):
            return F.lit(None).cast("double"), _DOUBLE
        if not xs:
            if inverse:
                raise FunctionError(f"({name}) needs an argument")
            return F.lit(unit).cast("long"), _LONG
        wide = _DOUBLE if name == "/" or any(isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)) for _, t in xs) else _LONG
        cols = [c.cast(wide) for c, _ in xs]
        if len(cols) == 1 and inverse:
            cols.insert(0, F.lit(unit).cast(wide))
        return reduce(op, cols), wide

    return f


def _integer(f: Callable[[Column, Column], Column]) -> Callable[..., Typed]:
    def g(*xs: Typed) -> Typed:
        a, b = map(millis, xs)
        if not all(isinstance(t, NUMERIC) for _, t in (a, b)):
            return F.lit(None).cast("long"), _LONG
        wide = _DOUBLE if any(isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)) for _, t in (a, b)) else _LONG
        x, y = a[0].cast(wide), F.nullif(b[0].cast(wide), F.lit(0).cast(wide))
        return f(x, y).cast(wide), wide

    return g


def _step(by: int) -> Callable[..., Typed]:
    return lambda x: _math("+", F.try_add, 0)(x, (F.lit(by).cast("long"), _LONG))


def _extreme(f: Callable[..., Column]) -> Callable[..., Typed]:
    def g(*xs: Typed) -> Typed:
        xs = tuple(map(millis, xs))
        if not xs or not all(isinstance(t, NUMERIC) for _, t in xs):
            return F.lit(None).cast("double"), _DOUBLE
        wide = _DOUBLE if any(isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)) for _, t in xs) else _LONG
        cols = [c.cast(wide) for c, _ in xs]
        whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
        return (F.when(whole, f(*cols)) if len(cols) > 1 else cols[0]), wide

    return g


def _str(*xs: Typed) -> Typed:
    return (F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c, _ in xs]) if xs else F.lit("")), _STRING


def _count(x: Typed) -> Typed:
    c, t = x
    if isinstance(t, SIZED):
        return F.when(c.isNull(), 0).otherwise(F.size(c)).cast("long"), _LONG
    if isinstance(t, T.StringType):
        return F.coalesce(F.length(c), F.lit(0)).cast("long"), _LONG
    return (F.when(c.isNull(), 0).cast("long")), _LONG


def _fold(both: bool) -> Callable[..., Typed]:
    def f(*xs: Typed) -> Typed:
        parts = [truthy(x) for x in xs]
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), parts, F.lit(both)), _BOOL

    return f


#: Name to (function, least arguments, most arguments or None).
FUNCTIONS: dict[str, tuple[Callable[..., Typed], int, int | None]] = {
    "=": (_equal, 1, None),
    "!=": (lambda *xs: (~_equal(*xs)[0], _BOOL), 1, None),
    "not=": (lambda *xs: (~_equal(*xs)[0], _BOOL), 1, None),
    "<": (_chain(lambda a, b: a < b), 1, None),
    ">": (_chain(lambda a, b: a > b), 1, None),
    "<=": (_chain(lambda a, b: a <= b), 1, None),
    ">=": (_chain(lambda a, b: a >= b), 1, None),
    "+": (_math("+", F.try_add, 0), 0, None),
    "-": (_math("-", F.try_subtract, 0, True), 1, None),
    "*": (_math("*", F.try_multiply, 1), 0, None),
    "/": (_math("/", F.try_divide, 1, True), 1, None),
    "mod": (_integer(lambda a, b: ((a % b) + b) % b), 2, 2),
    "quot": (_integer(lambda a, b: F.call_function("div", a.cast("long"), b.cast("long"))), 2, 2),
    "rem": (_integer(lambda a, b: a % b), 2, 2),
    "inc": (_step(1), 1, 1),
    "dec": (_step(-1), 1, 1),
    "max": (_extreme(F.greatest), 1, None),
    "min": (_extreme(F.least), 1, None),
    "str": (_str, 0, None),
    "count": (_count, 1, 1),
    "empty?": (lambda x: (_count(x)[0] == 0, _BOOL), 1, 1),
    "nil?": (lambda x: (x[0].isNull(), _BOOL), 1, 1),
    "some?": (lambda x: (x[0].isNotNull(), _BOOL), 1, 1),
    "true?": (lambda x: ((x[0].eqNullSafe(F.lit(True)) if isinstance(x[1], T.BooleanType) else F.lit(False)), _BOOL), 1, 1),
    "false?": (lambda x: ((x[0].eqNullSafe(F.lit(False)) if isinstance(x[1], T.BooleanType) else F.lit(False)), _BOOL), 1, 1),
    "boolean": (lambda x: (truthy(x), _BOOL), 1, 1),
    "not": (lambda x: (~truthy(x), _BOOL), 1, 1),
    "and": (_fold(True), 0, None),
    "or": (_fold(False), 0, None),
}


def register(name: str, f: Callable[..., Column], result: T.DataType, least: int = 1, most: int | None = None) -> None:
    """Add a scalar function made of columns; a name that is there already is an error."""
    if name in FUNCTIONS:
        raise FunctionError(f"{name} is taken")
    FUNCTIONS[name] = (lambda *xs: (f(*[c for c, _ in xs]), result), least, most)


def call(name: str, args: list[Typed]) -> Typed:
    if name not in FUNCTIONS:
        raise FunctionError(f"unknown function {name}")
    f, least, most = FUNCTIONS[name]
    if len(args) < least or (most is not None and len(args) > most):
        raise FunctionError(f"{name} does not take {len(args)} arguments")
    return f(*args)

"""Queries as data classes, and the parser from EDN."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from ..functions.aggregates import AGGREGATES
from . import edn
from .edn import Form, Keyword, Symbol


class QueryError(ValueError):
    """A query that cannot be run, with the reason."""


@dataclass(frozen=True)
class Var:
    name: str

    def __repr__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: object


class _Wild:
    def __repr__(self) -> str:
        return "_"


WILD = _Wild()


@dataclass(frozen=True)
class Pattern:
    """``[e a v]``; ``at``: time dimension to variable; ``closure``: the attribute's transitive closure, ``depth`` hops at most."""

    e: object
    a: str
    v: object = WILD
    at: tuple[tuple[str, Var], ...] = ()
    closure: bool = False
    depth: int | None = None


@dataclass(frozen=True)
class Pred:
    """``[(f args)]``: keep what is truthy."""

    fn: str
    args: tuple


@dataclass(frozen=True)
class Bind:
    """``[(f args) ?out]``; ``truthy``: the list form, which also drops what is not truthy."""

    fn: str
    args: tuple
    out: Var
    truthy: bool = False


@dataclass(frozen=True)
class Not:
    """``(not c...)``, or with ``vars`` ``(not-join [vars] c...)``."""

    clauses: tuple
    vars: tuple[Var, ...] | None = None


@dataclass(frozen=True)
class Or:
    """``(or b...)``, or with ``vars`` ``(or-join [vars] b...)``; a branch is a tuple of clauses."""

    branches: tuple[tuple, ...]
    vars: tuple[Var, ...] | None = None


@dataclass(frozen=True)
class RuleCall:
    name: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    fn: str
    params: tuple
    arg: object


@dataclass(frozen=True)
class Expr:
    fn: str
    args: tuple


@dataclass(frozen=True)
class Pull:
    var: Var
    pattern: object = field(hash=False)


@dataclass(frozen=True)
class Rule:
    name: str
    params: tuple[Var, ...]
    body: tuple


@dataclass(frozen=True)
class Query:
    find: tuple
    where: tuple
    inputs: tuple = ()
    as_of: Mapping[str, object] = field(default_factory=dict, hash=False)
    names: tuple[str, ...] | None = None

    @property
    def aggregates(self) -> bool:
        return any(isinstance(x, Agg) for x in self.find)


def term(x: object) -> object:
    if isinstance(x, Symbol):
        if x == "_":
            return WILD
        if x.startswith("?"):
            return Var(str(x))
        raise QueryError(f"{x} is neither a variable nor a value")
    return Const(tuple(x) if isinstance(x, list) else x)


def _variables(xs: object) -> tuple[Var, ...]:
    if not isinstance(xs, list) or not all(isinstance(x, Symbol) and x.startswith("?") for x in xs):
        raise QueryError(f"variables expected, not {xs}")
    return tuple(Var(str(x)) for x in xs)


def _pattern(c: list) -> Pattern:
    if len(c) < 2:
        raise QueryError(f"a pattern needs an entity and an attribute: {c}")
    e, a, rest = term(c[0]), c[1], c[2:]
    if not isinstance(a, Keyword):
        raise QueryError(f"the attribute of {c} must be a keyword; a variable is allowed in a rule that is called with one") if not (isinstance(a, Symbol) and a.startswith("?")) else _VariableAttribute(c)
    v = term(rest[0]) if rest and not (isinstance(rest[0], Keyword) and len(rest) % 2 == 0) else WILD
    rest = rest[1:] if len(rest) % 2 else rest
    at, depth = [], None
    for k, x in zip(rest[::2], rest[1::2], strict=True):
        if k == ":max-depth" and isinstance(x, int):
            depth = x
        elif str(k).startswith(":at/"):
            at.append((":time/" + k[4:], term(x)))
        else:
            raise QueryError(f"unknown modifier {k} in {c}")
    if a.endswith("+"):
        return Pattern(e, a[:-1], v, tuple(at), True, depth)
    if depth is not None:
        raise QueryError(f":max-depth is for transitive attributes: {c}")
    return Pattern(e, str(a), v, tuple(at))


class _VariableAttribute(QueryError):
    def __init__(self, c: list):
        super().__init__(f"{c}: a variable attribute is allowed only as a rule's parameter that is called with a keyword")


def clause(c: object) -> object:
    """One clause of ``:where``."""
    if isinstance(c, Form):
        if not c:
            raise QueryError("an empty clause")
        head = c[0]
        if head == "not":
            return Not(tuple(map(clause, c[1:])))
        if head == "not-join":
            return Not(tuple(map(clause, c[2:])), _variables(c[1]))
        if head in ("or", "or-join"):
            own = _variables(c[1]) if head == "or-join" else None
            branches = c[2:] if own is not None else c[1:]
            if not branches:
                raise QueryError(f"{head} needs a branch")
            return Or(tuple(_branch(b) for b in branches), own)
        from ..functions.scalar import FUNCTIONS

        args = tuple(map(term, c[1:]))
        if str(head) not in FUNCTIONS:
            return RuleCall(str(head), args)
        return Pred(str(head), args)
    if not isinstance(c, list) or not c:
        raise QueryError(f"not a clause: {c}")
    if isinstance(c[0], Form):
        fn, args = str(c[0][0]), tuple(map(term, c[0][1:]))
        if len(c) == 1:
            return Pred(fn, args)
        out = term(c[1])
        if len(c) != 2 or not isinstance(out, Var):
            raise QueryError(f"[(f args) ?out] expected, not {c}")
        return Bind(fn, args, out)
    return _pattern(c)


def _branch(b: object) -> tuple:
    if isinstance(b, Form) and b and b[0] == "and":
        return tuple(map(clause, b[1:]))
    if isinstance(b, list) and not isinstance(b, Form) and b and isinstance(b[0], list):
        if isinstance(b[0], Form) and (len(b) == 1 or isinstance(b[1], Symbol)):
            return (clause(b),)
        return tuple(map(clause, b))
    return (clause(b),)


def _find(x: object) -> object:
    if isinstance(x, list) and not isinstance(x, Form) and len(x) == 1 and isinstance(x[0], Form):
        x = x[0]
    if isinstance(x, Form):
        head = str(x[0])
        if head == "pull":
            if len(x) != 3 or not isinstance(x[1], Symbol):
                raise QueryError(f"(pull ?e pattern) expected, not {x}")
            return Pull(Var(str(x[1])), x[2])
        if head in AGGREGATES and not (head in ("max", "min", "count") and len(x) != 2):
            *params, arg = map(term, x[1:])
            if len(params) != AGGREGATES[head].params:
                raise QueryError(f"({head} ...) takes {AGGREGATES[head].params} numbers before its variable")
            return Agg(head, tuple(p.value for p in params), arg)
        return Expr(head, tuple(map(term, x[1:])))
    return term(x)


def parse(form: object) -> Query:
    """A query from EDN text, its data, or a map with ``:query`` and ``:as-of``."""
    if isinstance(form, Query):
        return form
    if isinstance(form, str):
        form = edn.read(form)
    as_of: dict = {}
    if isinstance(form, Mapping):
        as_of = dict(form.get(":as-of") or {})
        form = form.get(":query")
    if not isinstance(form, list) or not form or form[0] != ":find":
        raise QueryError("a query begins with :find")
    parts: dict[str, list] = {}
    for x in form:
        if isinstance(x, Keyword) and x in (":find", ":in", ":where", ":keys"):
            if x in parts:
                raise QueryError(f"{x} occurs twice")
            parts[str(x)] = own = []
        else:
            own.append(x)
    if not parts[":find"]:
        raise QueryError(":find is empty")
    inputs = tuple(Var(str(x)) for x in parts.get(":in", ()) if x not in ("$", "%"))
    names = tuple(map(str, parts[":keys"])) if ":keys" in parts else None
    where = list_forms(tuple(map(clause, parts.get(":where", ()))), set(inputs))
    q = Query(tuple(map(_find, parts[":find"])), where, inputs, as_of, names)
    if q.aggregates and any(isinstance(x, Pull) for x in q.find):
        raise QueryError("pull and aggregates do not go together")
    return q


def parse_rules(form: object) -> dict[str, list]:
    """Rules by name, as data: ``[(params, body), ...]``; bodies are parsed when a call has named their attributes."""
    if isinstance(form, str):
        form = edn.read(form)
    out: dict[str, list] = {}
    for r in form or ():
        if not r or not isinstance(r[0], Form) or len(r) < 2:
            raise QueryError(f"a rule is [(name ?x ...) clause ...], not {r}")
        out.setdefault(str(r[0][0]), []).append((_variables(list(r[0][1:])), list(r[1:])))
    for name, defs in out.items():
        if len({len(p) for p, _ in defs}) > 1:
            raise QueryError(f"the definitions of {name} differ in their number of parameters")
    return out


def list_forms(clauses: tuple, bound: set[Var]) -> tuple:
    """Predicates that end in a variable which nothing binds give it their value, if that is truthy: ``(f a b ?out)``."""
    own = bound.union(*(variables(c) for c in clauses if not isinstance(c, (Pred, Not)))) if clauses else bound
    out = []
    for c in clauses:
        if isinstance(c, Pred) and len(c.args) > 1 and isinstance(c.args[-1], Var) and c.args[-1] not in own:
            own = own | {c.args[-1]}
            c = Bind(c.fn, c.args[:-1], c.args[-1], True)
        out.append(c)
    made = []
    for c in out:
        if isinstance(c, Not):
            c = Not(list_forms(c.clauses, own if c.vars is None else set(c.vars)), c.vars)
        elif isinstance(c, Or):
            c = Or(tuple(list_forms(b, bound.union(*(variables(x) for x in out if x is not c and not isinstance(x, (Pred, Not, Or))))) for b in c.branches), c.vars)
        made.append(c)
    return tuple(made)


def with_inputs(q: Query, values: Mapping[str, object]) -> Query:
    """The query with its scalar inputs in place."""
    missing = [v.name for v in q.inputs if v.name not in values]
    if missing:
        raise QueryError(f"no value for {', '.join(missing)}")
    return replace(q, where=tuple(substitute(c, {v: Const(values[v.name]) for v in q.inputs}) for c in q.where), inputs=())


def substitute(c: object, by: Mapping) -> object:
    """A clause with terms replaced."""
    one = lambda x: by.get(x, x) if isinstance(x, Var) else x
    match c:
        case Pattern():
            return replace(c, e=one(c.e), v=one(c.v), at=tuple((d, one(x)) for d, x in c.at))
        case Pred() | RuleCall():
            return replace(c, args=tuple(map(one, c.args)))
        case Bind():
            return replace(c, args=tuple(map(one, c.args)), out=one(c.out))
        case Not():
            return Not(tuple(substitute(x, by) for x in c.clauses), None if c.vars is None else tuple(y for y in map(one, c.vars) if isinstance(y, Var)))
        case Or():
            return Or(tuple(tuple(substitute(x, by) for x in b) for b in c.branches), None if c.vars is None else tuple(y for y in map(one, c.vars) if isinstance(y, Var)))
    raise QueryError(f"not a clause: {c}")


def variables(c: object) -> set[Var]:
    """Variables that a clause shares with what is around it."""
    match c:
        case Pattern():
            return {x for x in (c.e, c.v, *(x for _, x in c.at)) if isinstance(x, Var)}
        case Pred() | RuleCall():
            return {x for x in c.args if isinstance(x, Var)}
        case Bind():
            return {x for x in (*c.args, c.out) if isinstance(x, Var)}
        case Not() | Or():
            if c.vars is not None:
                return set(c.vars)
            inner = c.clauses if isinstance(c, Not) else [x for b in c.branches for x in b]
            return set().union(*map(variables, inner)) if inner else set()
    return set()

"""Translation of queries to DataFrames.

A relation is a DataFrame with a column for each variable, and the variables known to identify a row. Knowing them
spares most ``distinct``s that set semantics would need. Patterns on the same entity of a table become one scan; joins go
along shared variables whatever the clauses' order; predicates apply as soon as their variables are bound.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.aggregates import AGGREGATES
from ..sources.catalog import MappedTable, literal
from ..storage import stage
from . import ast, closure
from .ast import WILD, Agg, Bind, Const, Expr, Not, Or, Pattern, Pred, Pull, Query, QueryError, RuleCall, Var
from .edn import Form, Symbol


def column_name(v: Var) -> str:
    """A variable's column."""
    return v.name.replace(".", "·").replace("`", "'")


def _unit_key() -> frozenset[Var]:
    return frozenset()


@dataclass(frozen=True)
class Relation:
    """``bound``: variables; those in ``virtual`` only tell rows apart and have no column. ``key``: variables that identify a row, if known."""

    df: DataFrame
    bound: frozenset[Var]
    key: frozenset[Var] | None = None
    virtual: frozenset[Var] = frozenset()
    nullable: frozenset[Var] = frozenset()

    @property
    def real(self) -> frozenset[Var]:
        return self.bound - self.virtual

    def typed(self, v: Var) -> scalar.Typed:
        if v in self.virtual:
            raise QueryError(f"{v} has no value here")
        c = column_name(v)
        return F.col(f"`{c}`"), self.df.schema[c].dataType

    def distinct(self) -> Relation:
        return self if self.key is not None else replace(self, df=self.df.distinct(), key=self.bound)

    def project(self, vs: Iterable[Var]) -> Relation:
        vs = [v for v in sorted(set(vs), key=lambda v: v.name) if v in self.real]
        key = self.key if self.key is not None and self.key <= set(vs) else None
        return Relation(self.df.select(*[F.col(f"`{column_name(v)}`") for v in vs]), frozenset(vs), key, frozenset(), self.nullable & set(vs))


class Planner:
    """Plans queries over a database's attributes, as of given times."""

    def __init__(self, spark: SparkSession, source: object, rules: Mapping[str, list] | None = None, as_of: Mapping[str, object] | None = None):
        self.spark, self.source, self.rules, self.as_of = spark, source, dict(rules or {}), dict(as_of or {})
        self.fresh = itertools.count()
        self.fixed: dict[str, DataFrame] = {}
        self.growing: dict[str, DataFrame] = {}
        self.recursive = self._recursive_rules()

    # -- rules

    def _calls(self, body: object) -> set[str]:
        found: set[str] = set()
        if isinstance(body, Form) and body and str(body[0]) in self.rules:
            found.add(str(body[0]))
        if isinstance(body, list):
            for x in body:
                found |= self._calls(x)
        return found

    def _recursive_rules(self) -> dict[str, set[str]]:
        """For each recursive rule, the rules it is recursive with."""
        calls = {n: set().union(*[self._calls(b) for _, b in defs]) for n, defs in self.rules.items()}
        reach = {n: set(c) for n, c in calls.items()}
        for _ in reach:
            for n in reach:
                reach[n] |= set().union(*[reach[m] for m in reach[n]]) if reach[n] else set()
        return {n: {m for m in reach[n] if n in reach.get(m, ())} for n in reach if n in reach[n]}

    def _body(self, params: tuple[Var, ...], body: list, args: tuple) -> tuple:
        """A rule's clauses for a call, its own variables renamed."""
        by: dict[str, object] = {}
        for p, a in zip(params, args, strict=True):
            by[p.name] = Symbol(a.name) if isinstance(a, Var) else Symbol("_") if a is WILD else a.value
        n = next(self.fresh)

        def put(x: object) -> object:
            if isinstance(x, Symbol) and x.startswith("?"):
                return by.setdefault(str(x), Symbol(f"{x}~{n}"))
            if isinstance(x, Form):
                return Form(map(put, x))
            return [put(y) for y in x] if isinstance(x, list) else x

        return tuple(ast.clause(put(c)) for c in body)

    def expand(self, clauses: Iterable) -> list:
        """Clauses with calls of rules that aren't recursive in place."""
        out = []
        for c in clauses:
            if isinstance(c, RuleCall):
                if c.name not in self.rules:
                    raise QueryError(f"unknown function or rule {c.name}")
                defs = self.rules[c.name]
                if len(defs[0][0]) != len(c.args):
                    raise QueryError(f"rule {c.name} takes {len(defs[0][0])} arguments")
                if c.name in self.recursive:
                    out.append(c)
                elif len(defs) == 1:
                    out += self.expand(self._body(*defs[0], c.args))
                else:
                    own = tuple(dict.fromkeys(a for a in c.args if isinstance(a, Var)))
                    out.append(Or(tuple(tuple(self.expand(self._body(p, b, c.args))) for p, b in defs), own))
            elif isinstance(c, Not):
                out.append(replace(c, clauses=tuple(self.expand(c.clauses))))
            elif isinstance(c, Or):
                out.append(replace(c, branches=tuple(tuple(self.expand(b)) for b in c.branches)))
            else:
                out.append(c)
        return out

    def rule_relation(self, name: str) -> DataFrame:
        """All tuples of a recursive rule (columns p0, p1 ...), by semi-naive iteration with the rules it is recursive with."""
        if name in self.growing:
            return self.growing[name]
        if name in self.fixed:
            return self.fixed[name]
        group = sorted(self.recursive[name] | {name})
        bodies = {n: [] for n in group}
        for n in group:
            for params, body in self.rules[n]:
                args = tuple(Var(f"?p{i}") for i in range(len(params)))
                clauses = self.expand(self._body(params, body, args))
                if any(isinstance(c, (Not, Or)) and self._uses(c, group) for c in clauses):
                    raise QueryError(f"rule {n}: a recursive call within not or or; write the branches as definitions")
                bodies[n].append((args, clauses, [i for i, c in enumerate(clauses) if isinstance(c, RuleCall) and c.name in group]))
        total: dict[str, DataFrame] = {}
        for n in group:
            base = [self._tuples(args, c) for args, c, calls in bodies[n] if not calls]
            if base:
                total[n] = stage(_union(base).distinct())
        delta = dict(total)
        while delta:
            found: dict[str, list[DataFrame]] = {}
            for n in group:
                for args, clauses, calls in bodies[n]:
                    for i in calls:
                        if clauses[i].name not in delta or any(clauses[j].name not in total for j in calls):
                            continue
                        found.setdefault(n, []).append(self._tuples(args, clauses, {i: delta[clauses[i].name]}, total))
            delta = {}
            for n, parts in found.items():
                new = _union(parts).distinct()
                if n in total:
                    new = new.join(total[n], new.columns, "left_anti")
                new = stage(new)
                if not new.isEmpty():
                    delta[n] = new
                    total[n] = total[n].unionByName(new) if n in total else new
        for n in group:
            if n not in total:
                raise QueryError(f"rule {n} has no definition to begin with")
            self.fixed[n] = total[n]
        return self.fixed[name]

    def _uses(self, c: object, group: list[str]) -> bool:
        inner = c.clauses if isinstance(c, Not) else [x for b in c.branches for x in b]
        return any((isinstance(x, RuleCall) and x.name in group) or (isinstance(x, (Not, Or)) and self._uses(x, group)) for x in inner)

    def _tuples(self, args: tuple[Var, ...], clauses: list, deltas: Mapping[int, DataFrame] | None = None, total: Mapping[str, DataFrame] | None = None) -> DataFrame:
        own = [_Given(c, deltas[i]) if deltas and i in deltas else _Given(c, total[c.name]) if isinstance(c, RuleCall) and total and c.name in total else c for i, c in enumerate(clauses)]
        rel = self.conjunction(own, set(args))
        if set(args) - rel.real:
            raise QueryError(f"a rule leaves {', '.join(v.name for v in set(args) - rel.real)} unbound")
        return rel.df.select(*[F.col(f"`{column_name(a)}`").alias(f"p{i}") for i, a in enumerate(args)])

    # -- clauses

    def conjunction(self, clauses: Iterable, needed: set[Var], seed: Relation | None = None) -> Relation:
        """The relation of all clauses; ``needed``: variables used outside."""
        todo = self.expand(clauses)
        uses = Counter(v for c in todo for v in self._mentions(c))
        scans = self._scans(todo, needed, uses, seed)
        rest = [c for c in todo if not isinstance(c, Pattern) and not (isinstance(c, _Given))]
        rel = seed
        pending = list(scans)
        while True:
            rel, rest = self._apply(rel, rest)
            if pending:
                pending.sort(key=lambda s: (not (rel is None or s.vars & rel.bound or not s.vars), s.multiplies(rel), s.cost(rel)))
                rel = self._join_scan(rel, pending.pop(0), rest)
                continue
            # what is left may bind: a disjunction, a call, then negations
            nxt = next((c for c in rest if isinstance(c, (Or, RuleCall))), None)
            if nxt is None:
                break
            rest.remove(nxt)
            rel = self._call(rel, nxt) if isinstance(nxt, RuleCall) else self._or(rel, nxt, needed | {v for c in todo if c is not nxt for v in self._mentions(c)})
        rel = rel if rel is not None else self._unit()
        stuck = [c for c in rest if isinstance(c, (Pred, Bind))]
        if stuck:
            loose = set().union(*map(ast.variables, stuck)) - rel.bound
            raise QueryError(f"nothing binds {', '.join(sorted(v.name for v in loose))}")
        for c in rest:
            rel = self._not(rel, c)
        return rel

    def _mentions(self, c: object) -> list[Var]:
        if isinstance(c, _Given):
            c = c.call
        if isinstance(c, Not):
            return [v for x in c.clauses for v in self._mentions(x)] + list(c.vars or ())
        if isinstance(c, Or):
            return [v for b in c.branches for x in b for v in self._mentions(x)] + list(c.vars or ())
        return [x for x in (c.e, c.v, *(x for _, x in c.at)) if isinstance(x, Var)] if isinstance(c, Pattern) else [v for v in (*getattr(c, "args", ()), getattr(c, "out", None)) if isinstance(v, Var)]

    def _unit(self) -> Relation:
        return Relation(self.spark.range(1).select(), frozenset(), _unit_key())

    def _scans(self, todo: list, needed: set[Var], uses: Counter, seed: Relation | None) -> list[_Scan]:
        fused: dict[tuple, list[Pattern]] = {}
        out: list[_Scan] = []
        for c in todo:
            if isinstance(c, _Given):
                out.append(_Scan(frozenset(v for v in c.call.args if isinstance(v, Var)), lambda rel, c=c: self._given(c), 1, key=frozenset(v for v in c.call.args if isinstance(v, Var))))
            elif isinstance(c, Pattern) and c.closure:
                out.append(_Scan(frozenset(ast.variables(c)), lambda rel, c=c: self._closure(c, rel), 1, late=not (isinstance(c.e, Const) or isinstance(c.v, Const)), key=frozenset(ast.variables(c))))
            elif isinstance(c, Pattern):
                found = self.source.column(c.a)
                if found is not None and not c.at:
                    fused.setdefault((found[0].name, c.e if c.e is not WILD else next(self.fresh)), []).append(c)
                else:
                    out.append(_Scan(frozenset(ast.variables(c)), lambda rel, c=c: self._fact_scan(c), sum(isinstance(x, Const) for x in (c.e, c.v)), key=frozenset(ast.variables(c))))
        for ps in fused.values():
            t, e = self.source.column(ps[0].a)[0], ps[0].e
            inside = sum(p.e == e for p in ps) if isinstance(e, Var) else 0
            virtual = isinstance(e, Var) and t.key is None and uses[e] == inside and e not in needed and (seed is None or e not in seed.bound)
            vs = frozenset().union(*[ast.variables(p) for p in ps])
            key = frozenset([e]) if isinstance(e, Var) else frozenset() if isinstance(e, Const) else None
            out.append(_Scan(vs, lambda rel, t=t, ps=ps, virtual=virtual: self._table_scan(t, ps, virtual), sum(isinstance(x, Const) for p in ps for x in (p.e, p.v)), key=key))
        return out

    def _table_scan(self, t: MappedTable, ps: list[Pattern], virtual: bool) -> Relation:
        e = ps[0].e
        df = t.rows(numbered=isinstance(e, (Var, Const)) and not virtual)
        bound: dict[Var, str] = {}
        cond = F.lit(True)
        if isinstance(e, Var) and not virtual:
            bound[e] = t.entity
        elif isinstance(e, Const):
            cond &= _equals(e.value, df, t.entity)
        for p in ps:
            c = self.source.column(p.a)[1]
            if isinstance(p.v, Const):
                cond &= _equals(p.v.value, df, c)
            else:
                cond &= F.col(f"`{c}`").isNotNull()
                if isinstance(p.v, Var):
                    if p.v in bound:
                        cond &= scalar.call("=", [(F.col(f"`{x}`"), df.schema[x].dataType) for x in (c, bound[p.v])])[0]
                    else:
                        bound[p.v] = c
        df = df.where(cond).select(*[F.col(f"`{c}`").alias(column_name(v)) for v, c in bound.items()])
        key = frozenset([e]) if isinstance(e, Var) else frozenset() if isinstance(e, Const) else None
        hidden = frozenset([e]) if virtual else frozenset()
        return Relation(df, frozenset(bound) | hidden, key, hidden)

    def _fact_scan(self, p: Pattern) -> Relation:
        df, single = self.source.facts(p.a, self.as_of, tuple(d for d, _ in p.at))
        cond, bound = F.lit(True), {}
        for x, c in ((p.e, "e"), (p.v, "v"), *((v, f"t{i}") for i, (_, v) in enumerate(p.at))):
            if isinstance(x, Const):
                cond &= _equals(x.value, df, c)
            elif isinstance(x, Var):
                if x in bound:
                    cond &= scalar.call("=", [(F.col(y), df.schema[y].dataType) for y in (c, bound[x])])[0]
                else:
                    bound[x] = c
        df = df.where(cond).select(*[F.col(c).alias(column_name(v)) for v, c in bound.items()])
        key = None
        if not p.at:
            want = [x for x in ((p.e,) if single else (p.e, p.v))]
            if all(isinstance(x, (Var, Const)) for x in want):
                key = frozenset(x for x in want if isinstance(x, Var))
        return Relation(df, frozenset(bound), key)

    def _closure(self, p: Pattern, rel: Relation | None) -> Relation:
        edges = self.source.edges(p.a, self.as_of)
        ends = {}
        for x, side in ((p.e, "src"), (p.v, "dst")):
            if isinstance(x, Const):
                kind = edges.schema["src"].dataType
                ends[side] = self.spark.range(1).select(F.lit(x.value).cast(kind).alias("x"))
            elif isinstance(x, Var) and rel is not None and x in rel.real:
                ends[side] = rel.df.select(F.col(f"`{column_name(x)}`").alias("x")).distinct()
        const = {s for x, s in ((p.e, "src"), (p.v, "dst")) if isinstance(x, Const)}
        side = next(iter(sorted(const, reverse=True)), None) or next(iter(sorted(ends, reverse=True)), None)
        df = closure.pairs(edges, ends.get(side), side, p.depth)
        cond, bound = F.lit(True), {}
        for x, c in ((p.e, "src"), (p.v, "dst")):
            if isinstance(x, Const):
                cond &= _equals(x.value, df, c)
            elif isinstance(x, Var):
                if x in bound:
                    cond &= F.col(c) == F.col(bound[x])
                else:
                    bound[x] = c
        df = df.where(cond).select(*[F.col(c).alias(column_name(v)) for v, c in bound.items()])
        whole = p.e is not WILD and p.v is not WILD
        return Relation(df, frozenset(bound), frozenset(bound) if whole else None)

    def _given(self, c: _Given) -> Relation:
        cond, bound = F.lit(True), {}
        for i, a in enumerate(c.call.args):
            if isinstance(a, Const):
                cond &= _equals(a.value, c.df, f"p{i}")
            elif isinstance(a, Var):
                if a in bound:
                    cond &= F.col(f"p{i}").eqNullSafe(F.col(bound[a]))
                else:
                    bound[a] = f"p{i}"
        df = c.df.where(cond).select(*[F.col(x).alias(column_name(v)) for v, x in bound.items()])
        return Relation(df, frozenset(bound), frozenset(bound) if not any(a is WILD for a in c.call.args) else None)

    def _join_scan(self, rel: Relation | None, scan: _Scan, later: list) -> Relation:
        return self.join(rel, scan.make(rel), later)

    def join(self, a: Relation | None, b: Relation, later: Iterable = ()) -> Relation:
        """Natural join; a semi-join where ``b`` binds nothing new; a product where nothing is shared. ``later``: clauses still to be applied."""
        if a is None:
            return b
        shared = sorted(a.real & b.real, key=lambda v: v.name)
        tied = any(isinstance(c, Pred) and c.fn == "=" and all(len(set(c.args) & (r.real - set(shared))) == 1 for r in (a, b)) for c in later)  # becomes a part of the join
        key = None
        if a.key is not None and b.key is not None:
            key = a.key if b.key <= set(shared) else b.key if a.key <= set(shared) else a.key | b.key
        elif a.key is not None and not (b.bound - set(shared)):
            key = a.key
        rest = dict(bound=a.bound | b.bound, virtual=a.virtual | b.virtual, nullable=a.nullable | b.nullable)
        if not shared:
            if not b.real and not b.virtual:
                b = replace(b, df=b.df.limit(1), key=frozenset())
                key = a.key
            return Relation(a.df.crossJoin(b.df), key=key, **rest)
        names = [column_name(v) for v in shared]
        both = a.nullable & b.nullable & set(shared)
        if b.bound <= a.bound and not b.virtual:
            return Relation(_join(a.df, b.df, names, "left_semi", both), key=a.key, **rest)
        if not both and not tied and not any(r.key is not None and r.key <= set(shared) for r in (a, b)):
            return Relation(_spread(a.df, b.df, names), key=key, **rest)
        if not both and (key is None or key & rest["virtual"]):  # rows that are made distinct later, in the same tasks
            return Relation(_parted(a.df, b.df, names), key=key, **rest)
        return Relation(_join(a.df, b.df, names, "inner", both), key=key, **rest)

    def _apply(self, rel: Relation | None, rest: list) -> tuple[Relation | None, list]:
        """Apply the predicates whose variables are bound."""
        again = True
        while again:
            again = False
            for c in rest:
                have = rel.real if rel is not None else frozenset()
                if isinstance(c, (Pred, Bind)) and {v for v in c.args if isinstance(v, Var)} <= have:
                    rel = self._predicate(rel if rel is not None else self._unit(), c)
                    rest = [x for x in rest if x is not c]
                    again = True
                    break
        return rel, rest

    def _args(self, rel: Relation, args: tuple) -> list[scalar.Typed]:
        out = []
        for a in args:
            if isinstance(a, Var):
                out.append(rel.typed(a))
            elif isinstance(a, Const):
                out.append(constant(a.value))
            else:
                raise QueryError("_ is not an argument")
        return out

    def _predicate(self, rel: Relation, c: Pred | Bind) -> Relation:
        try:
            value = scalar.call(c.fn, self._args(rel, c.args))
        except scalar.FunctionError as e:
            raise QueryError(str(e)) from None
        if isinstance(c, Pred):
            return replace(rel, df=rel.df.where(scalar.truthy(value)))
        if c.out in rel.real:
            return replace(rel, df=rel.df.where(scalar.call("=", [rel.typed(c.out), value])[0]))
        name = column_name(c.out)
        df = rel.df.withColumn(name, value[0])
        out = Relation(df, rel.bound | {c.out}, rel.key, rel.virtual, rel.nullable | {c.out})
        return replace(out, df=df.where(scalar.truthy(out.typed(c.out)))) if c.truthy else out

    def _inner(self, rel: Relation, clauses: Iterable, shared: set[Var]) -> Relation:
        """Clauses of a negation or branch, over the outer bindings where they need them."""
        clauses = list(clauses)
        binds = set().union(*[ast.variables(c) for c in self.expand(clauses) if not isinstance(c, (Pred, Not))]) if clauses else set()
        binds -= {v for c in clauses if isinstance(c, Bind) for v in c.args if isinstance(v, Var) and not any(v in ast.variables(x) for x in clauses if isinstance(x, (Pattern, Or, RuleCall)))}
        wanted = set().union(*[set(self._mentions(c)) for c in clauses]) if clauses else set()
        seed = (wanted & rel.real) - binds
        loops = any(isinstance(c, Pattern) and c.closure and not isinstance(c.e, Const) and not isinstance(c.v, Const) for c in clauses)
        start = rel.project(wanted & rel.real).distinct() if seed or (loops and wanted & rel.real) else None
        return self.conjunction(clauses, shared, start)

    def _not(self, rel: Relation, c: Not) -> Relation:
        if not isinstance(c, Not):
            raise QueryError(f"cannot place {c}")
        names = set(c.vars) if c.vars is not None else set().union(*[set(self._mentions(x)) for x in c.clauses])
        if c.vars is not None and set(c.vars) - rel.real:
            raise QueryError(f"nothing binds {', '.join(v.name for v in set(c.vars) - rel.real)} of not-join")
        clauses = c.clauses
        if c.vars is not None:  # other variables are its own
            own = {v: Var(f"{v.name}~{next(self.fresh)}") for x in clauses for v in self._mentions(x) if v not in names}
            clauses = tuple(ast.substitute(x, own) for x in clauses)
        inner = self._inner(rel, clauses, names & rel.real)
        shared = sorted(names & rel.real & inner.real, key=lambda v: v.name)
        if not shared:
            return replace(rel, df=rel.df.join(inner.df.limit(1).select(F.lit(True).alias("__any")), F.col("__any"), "left_anti"))
        right = inner.project(shared)
        return replace(rel, df=_join(rel.df, right.df, [column_name(v) for v in shared], "left_anti", rel.nullable & inner.nullable))

    def _or(self, rel: Relation | None, c: Or, outside: set[Var]) -> Relation:
        outer = rel if rel is not None else self._unit()
        branches = c.branches
        if c.vars is not None:
            fixed = []
            for b in branches:
                own = {v: Var(f"{v.name}~{next(self.fresh)}") for x in b for v in self._mentions(x) if v not in c.vars}
                fixed.append(tuple(ast.substitute(x, own) for x in b))
            branches = tuple(fixed)
            names = set(c.vars)
        else:
            own = [set().union(*[set(self._mentions(x)) for x in b]) for b in branches]
            # what only some branches mention, and nothing outside, is theirs
            names = set().union(*own) & (set.intersection(*own) | outside | outer.real)
        inner = [self._inner(outer, b, names) for b in branches]
        known = [r.real & names for r in inner]
        if all(k == known[0] for k in known):
            parts = [r.project(known[0]) for r in inner]
            df = _union([p.df for p in parts]).distinct() if len(parts) > 1 else parts[0].distinct().df
            nullable = frozenset().union(*[p.nullable for p in parts])
            return self.join(rel, Relation(df, known[0], known[0], frozenset(), nullable))
        # a branch that leaves out what the others bind must have it from outside
        if any((set().union(*known) - k) - outer.real for k in known):
            raise QueryError("the branches of or bind different variables")
        wide = [self.join(outer, r.project(k)) for r, k in zip(inner, known, strict=True)]
        names_out = sorted(wide[0].real, key=lambda v: v.name)
        df = _union([w.df.select(*[F.col(f"`{column_name(v)}`") for v in names_out]) for w in wide]).distinct()
        return Relation(df, frozenset(names_out), frozenset(names_out), frozenset(), outer.nullable)

    def _call(self, rel: Relation | None, c: RuleCall) -> Relation:
        return self.join(rel, self._given(_Given(c, self.rule_relation(c.name))))

    # -- results

    def run(self, q: Query, names: Iterable[str] | None = None) -> DataFrame:
        needed: set[Var] = set()
        for x in q.find:
            if isinstance(x, Var):
                needed.add(x)
            elif isinstance(x, Expr):
                needed |= {v for v in x.args if isinstance(v, Var)}
            elif isinstance(x, Pull):
                needed.add(x.var)
            elif isinstance(x, Agg) and isinstance(x.arg, Var) and x.fn != "count":
                needed.add(x.arg)
        rel = self.conjunction(q.where, needed)
        loose = needed | {x.arg for x in q.find if isinstance(x, Agg) and isinstance(x.arg, Var)}
        if loose - rel.bound:
            raise QueryError(f"nothing binds {', '.join(sorted(v.name for v in loose - rel.bound))}")
        names = list(names or q.names or _result_names(q.find))
        if len(names) != len(q.find) or len(set(names)) != len(names):
            raise QueryError(f"{len(q.find)} different names needed, not {names}")
        return self._aggregate(rel, q, names) if q.aggregates else self._plain(rel, q, names)

    def _value(self, rel: Relation, x: object) -> Column:
        if isinstance(x, Var):
            return rel.typed(x)[0]
        if isinstance(x, Const):
            return constant(x.value)[0]
        try:
            return scalar.call(x.fn, self._args(rel, x.args))[0]
        except scalar.FunctionError as e:
            raise QueryError(str(e)) from None

    def _plain(self, rel: Relation, q: Query, names: list[str]) -> DataFrame:
        for i, x in enumerate(q.find):
            if isinstance(x, Pull):
                if rel.key is None:
                    rel = rel.distinct()
                ids = rel.project([x.var]).distinct().df.select(F.col(f"`{column_name(x.var)}`").alias("id"))
                pulled = self.source.pull(ids, x.pattern, self.as_of).select(F.col("id").alias(f"__id{i}"), F.col("pulled").alias(f"__pull{i}"))
                rel = replace(rel, df=rel.df.join(pulled, F.col(f"`{column_name(x.var)}`") == F.col(f"__id{i}"), "left").drop(f"__id{i}"))
        cols = [(F.col(f"__pull{i}") if isinstance(x, Pull) else self._value(rel, x)).alias(n) for i, (x, n) in enumerate(zip(q.find, names, strict=True))]
        df = rel.df.select(*cols)
        kept = {x for x in q.find if isinstance(x, Var)} | {x.var for x in q.find if isinstance(x, Pull)}
        if rel.key is not None and rel.key <= kept:
            return df
        return df.dropDuplicates([n for x, n in zip(q.find, names, strict=True) if not isinstance(x, Pull)] or names) if any(isinstance(x, Pull) for x in q.find) else df.distinct()

    def _aggregate(self, rel: Relation, q: Query, names: list[str]) -> DataFrame:
        rel = rel.distinct()  # one value for each distinct binding
        groups = [self._value(rel, x).alias(n) for x, n in zip(q.find, names, strict=True) if not isinstance(x, Agg)]
        aggs = []
        for x, n in zip(q.find, names, strict=True):
            if isinstance(x, Agg):
                c, t = (F.lit(1), T.IntegerType()) if x.fn == "count" else rel.typed(x.arg) if isinstance(x.arg, Var) else constant(x.arg.value)
                aggs.append(AGGREGATES[x.fn].make(c, t, *x.params).alias(n))
        out = rel.df.groupBy(*groups).agg(*aggs) if groups else rel.df.agg(*aggs)
        return out.select(*[F.col(f"`{n}`") for n in names])


@dataclass(frozen=True)
class _Given:
    """A call of a rule whose tuples are there."""

    call: RuleCall
    df: DataFrame

    @property
    def args(self) -> tuple:
        return self.call.args


@dataclass
class _Scan:
    vars: frozenset[Var]
    make: object
    constants: int
    late: bool = False
    key: frozenset[Var] | None = None

    def multiplies(self, rel: Relation | None) -> bool:
        """Whether rows of both sides may meet several of the other's, so that the join may have more rows than either."""
        if rel is None or not self.vars & rel.bound:
            return False
        return not (self.key is not None and self.key <= rel.bound or rel.key is not None and rel.key <= self.vars)

    def cost(self, rel: Relation | None) -> tuple:
        return (self.late and not (rel is not None and self.vars & rel.bound), -self.constants, len(self.vars))


def constant(value: object) -> scalar.Typed:
    """A literal and its type."""
    if isinstance(value, bool):
        return F.lit(value), T.BooleanType()
    if isinstance(value, int):
        return F.lit(value).cast("long"), T.LongType()
    if isinstance(value, float):
        return F.lit(value), T.DoubleType()
    if isinstance(value, str):
        return F.lit(str(value)), T.StringType()
    if value is None:
        return F.lit(None), T.NullType()
    if hasattr(value, "isoformat"):
        return F.lit(value).cast("timestamp"), T.TimestampType()
    if isinstance(value, (tuple, list)):
        inner = constant(value[0])[1] if value else T.NullType()
        return F.array(*[constant(v)[0] for v in value]), T.ArrayType(inner)
    raise QueryError(f"{value!r} is not a constant of a query")


def _equals(value: object, df: DataFrame, column: str) -> Column:
    c = literal(value, df.schema[column].dataType)
    return F.lit(False) if c is None else F.col(f"`{column}`") == c


def _join(a: DataFrame, b: DataFrame, names: list[str], how: str, null_safe: frozenset[Var]) -> DataFrame:
    safe = {column_name(v) for v in null_safe}
    if not safe & set(names):
        return a.join(b, names, how)
    renamed = b.select(*[F.col(f"`{c}`").alias(f"__{c}" if c in names else c) for c in b.columns])
    cond = [F.col(f"`{n}`").eqNullSafe(F.col(f"`__{n}`")) if n in safe else F.col(f"`{n}`") == F.col(f"`__{n}`") for n in names]
    out = a.join(renamed, cond, how)
    return out.drop(*[f"__{n}" for n in names]) if how == "inner" else out


#: Rows a side that meet in one task where a join multiplies, and the most tasks that it is dealt to.
PIECE, TASKS = 4_096, 10_000


def _size(df: DataFrame) -> int:
    """Bytes, as the planner estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes of files for each task of a join whose rows are made distinct: it sorts both sides and holds its distinct rows at once.
SHARE = 8_000_000


def _parted(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """An inner join in tasks whose number follows the files that are read; an ordinary one where they are few or one side may be broadcast."""
    leaves = [df._jdf.queryExecution().optimizedPlan().collectLeaves() for df in (a, b)]
    read = sum(int(str(x.apply(i).stats().sizeInBytes())) for x in leaves for i in range(x.size()))
    tasks = min(TASKS, math.ceil(read / SHARE))
    few = a._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    if tasks <= 8 or read > 1e17 or min(_size(a), _size(b)) <= few:  # a frame that isn't of files may have no known size
        return a.join(b, names)
    cols = [F.col(f"`{n}`") for n in names]
    return a.repartition(tasks, *cols).join(b.repartition(tasks, *cols), names)


def _spread(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """An inner join of which both sides may have many rows of a value: each side's are cut into pieces, and every piece meets every one of the other's.

    Rows are counted first; where few pairs come out, this is an ordinary join. A pair's two pieces meet in one place only, so no pair comes twice.
    """
    if _size(a) * _size(b) < 1e10:
        return a.join(b, names)
    cols = [F.col(f"`{n}`") for n in names]
    count = lambda df, n: df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
    sizes = count(a, "__a").join(count(b, "__b"), names).withColumn("__pairs", F.col("__a").cast("double") * F.col("__b"))
    pairs = sizes.agg(F.sum("__pairs")).first()[0] or 0
    if pairs < 8 * PIECE**2:
        return a.join(b, names)
    grid = stage(sizes.where(F.col("__pairs") > PIECE**2).select(*cols, *[F.ceil(F.col(n) / PIECE).alias(p) for n, p in (("__a", "__m"), ("__b", "__n"))]))

    def dealt(df: DataFrame, own: str, other: str, place: str, copies: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce(own, F.lit(1).cast("long")))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1).cast("long")) - 1))
        put = df.join(grid, names, "left").select(*[F.col(f"`{c}`") for c in df.columns], at.alias(place), every.alias(copies))
        return put.repartition(tasks, *cols, F.col("__i"), F.col("__j"))

    tasks = min(TASKS, math.ceil(pairs / PIECE**2))
    left, right = dealt(a, "__m", "__n", "__i", "__j"), dealt(b, "__n", "__m", "__j", "__i")
    return left.hint("merge").join(right, [*names, "__i", "__j"]).drop("__i", "__j")


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def _result_names(find: tuple) -> list[str]:
    out: list[str] = []
    for x in find:
        base = x.name.lstrip("?") if isinstance(x, Var) else x.var.name.lstrip("?") if isinstance(x, Pull) else f"{x.fn}_{x.arg.name.lstrip('?')}" if isinstance(x, Agg) and isinstance(x.arg, Var) else "value"
        name, n = base, 1
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out

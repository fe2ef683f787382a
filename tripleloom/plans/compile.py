"""Conditions and heads to DataFrame plans.

A condition is a DataFrame with one column for each bound variable. Patterns are ordered
so that each shares a variable with what came before where it can, constants first;
filters, negation and builtins are placed as soon as their variables are bound. The join
algorithm, pushdown and pruning are Catalyst's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import terms
from .ast import And, Atom, Const, Equal, Exists, External, Frame, ListTerm, Member, Not, Or, Var, conjuncts, variables
from .parser import RuleError

#: name -> function of the argument columns to a boolean column. Users add theirs here.
BUILTINS: dict[str, Callable[..., Column]] = {
    "pred:is-literal-XMLLiteral": lambda t: F.coalesce(terms.datatype(t) == "http://www.w3.org/1999/02/22-rdf-syntax-ns#XMLLiteral", F.lit(False)),
    "pred:is-literal-PlainLiteral": lambda t: F.coalesce(terms.is_plain_literal(t), F.lit(False)),
    "pred:is-iri": lambda t: F.coalesce(terms.kind(t) == terms.IRI, F.lit(False)),
    "pred:is-literal": lambda t: terms.is_literal(t),
}
#: Below this many estimated bytes a pattern with a constant predicate is small enough to be broadcast.
BROADCAST_BYTES = 8 << 20

_v = "v_{}".format


def _term(x, df: DataFrame | None = None) -> Column:
    return F.lit(x.term) if isinstance(x, Const) else F.col(_v(x.name))


def scan(relation: DataFrame, columns: list[str], args: list) -> DataFrame:
    """Rows of ``relation`` that match ``args``: constants filter, a repeated variable means equality."""
    if any(isinstance(a, ListTerm) for a in args):
        return relation.where(F.lit(False)).select(*[F.lit(None).cast("string").alias(_v(n)) for n in sorted(set().union(*map(variables, args)))])
    out, first = relation, {}
    for c, a in zip(columns, args):
        if isinstance(a, Const):
            out = out.where(F.col(c) == a.term)
        elif a.name in first:
            out = out.where(F.col(first[a.name]) == F.col(c))
        else:
            first[a.name] = c
    return out.select(*[F.col(c).alias(_v(n)) for n, c in first.items()])


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Equi-join on all shared variables; every pair where there is none."""
    shared = [c for c in a.columns if c in b.columns]
    if not b.columns:  # a ground pattern: all or nothing
        return a.join(b.limit(1), how="cross")
    return a.join(b, shared) if shared else a.crossJoin(b)


def patterns(c) -> list:
    """Patterns of a conjunction, frames cut into one-slot frames."""
    out = []
    for p in conjuncts(c):
        if isinstance(p, Frame):
            out += [Frame(p.subject, (s,)) for s in p.slots]
        elif isinstance(p, Atom):
            out.append(p)
    return out


def _args(p) -> tuple[str, list, list[str]]:
    if isinstance(p, Atom):
        return p.name, list(p.args), [f"a{k}" for k in range(len(p.args))]
    ((pred, obj),) = p.slots
    return "T", [p.subject, pred, obj], ["s", "p", "o"]


def disjuncts(c) -> list[list]:
    """Disjunctive form: lists of conjuncts."""
    if isinstance(c, And):
        out = [[]]
        for p in c.parts:
            out = [a + b for a in out for b in disjuncts(p)]
        return out
    if isinstance(c, Or):
        return [d for p in c.parts for d in disjuncts(p)]
    return [[c]]


class Compiler:
    """``relation(name, arity, k, pattern)`` gives the DataFrame that the k-th pattern of a body reads."""

    def __init__(self, relation, builtins=None):
        self.relation, self.builtins = relation, BUILTINS if builtins is None else builtins

    def condition(self, c) -> DataFrame:
        parts = [self.conjunction(d) for d in disjuncts(c)]
        if len(parts) == 1:
            return parts[0]
        shared = [n for n in parts[0].columns if all(n in p.columns for p in parts)]
        return reduce(DataFrame.union, [p.select(*shared) for p in parts]).distinct()

    def conjunction(self, parts: list) -> DataFrame:
        flat = conjuncts(And(tuple(parts)))
        todo = list(enumerate(patterns(And(tuple(flat)))))
        rest = [p for p in flat if not isinstance(p, (Frame, Atom))]
        out: DataFrame | None = None
        bound: set[str] = set()
        while todo or rest:
            out, bound, rest, moved = self._place(out, bound, rest)
            if todo:
                def cost(item):
                    _, args, _ = _args(item[1])
                    fixed = sum(isinstance(a, Const) for a in args)
                    linked = bool(bound & variables(item[1])) or not bound
                    return (not linked, -fixed - sum(isinstance(a, Var) and a.name in bound for a in args), item[0])

                k, p = item = min(todo, key=cost)
                todo.remove(item)
                name, args, columns = _args(p)
                got = scan(self.relation(name, len(args), k, p), columns, args)
                out = got if out is None else natural_join(out, got)
                bound |= variables(p)
            elif rest and not moved:
                raise RuleError(f"variables never bound: {', '.join(map(str, rest))}")
        if out is None:
            raise RuleError("an empty body has no rows; facts are asserted at once")
        return out

    def _place(self, out, bound, rest):
        """Apply every filter, binding and sub-condition whose variables allow it."""
        moved, left = False, []
        for p in rest:
            done, out, bound = self._apply(out, bound, p)
            moved |= done
            if not done:
                left.append(p)
        return out, bound, left, moved

    def _one(self, out):
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession().range(1).select() if out is None else out

    def _apply(self, out, bound, p):
        negated, q = (True, p.body) if isinstance(p, Not) else (False, p)
        if isinstance(q, Equal):
            sides = [q.left, q.right]
            free = [x for x in sides if isinstance(x, Var) and x.name not in bound]
            if not free:
                if all(isinstance(x, Const) for x in sides):
                    same = sides[0].term == sides[1].term
                    return True, self._one(out).where(F.lit(same != negated)), bound
                test = _term(sides[0]) == _term(sides[1])
                return True, out.where(~test if negated else test), bound
            if negated or len(free) == 2:
                return False, out, bound
            (other,) = [x for x in sides if x is not free[0]]
            return True, self._one(out).withColumn(_v(free[0].name), _term(other)), bound | {free[0].name}
        if isinstance(q, External) and q.name == "pred:list-contains":
            items, member = q.args
            values = [x.term for x in items.items]
            if isinstance(member, Const):
                return True, self._one(out).where(F.lit((member.term in values) != negated)), bound
            if member.name in bound:
                test = F.col(_v(member.name)).isin(values)
                return True, out.where(~test if negated else test), bound
            if negated:
                return False, out, bound
            each = F.explode(F.array(*map(F.lit, dict.fromkeys(values)))) if values else F.explode(F.array().cast("array<string>"))
            return True, self._one(out).withColumn(_v(member.name), each), bound | {member.name}
        if isinstance(q, External):
            if not variables(q) <= bound:
                return False, out, bound
            if q.name not in self.builtins:
                raise RuleError(f"unsupported builtin {q.name}")
            test = self.builtins[q.name](*map(_term, q.args))
            return True, self._one(out).where(~test if negated else test), bound
        if negated:
            raise RuleError(f"only equality and builtins can be negated: {p}")
        if isinstance(q, Exists):
            inner = self.condition(q.body)
            inner = inner.select(*[c for c in inner.columns if c[2:] not in q.names]).distinct()
            new = {c[2:] for c in inner.columns}
            return True, inner if out is None else natural_join(out, inner), bound | new
        if isinstance(q, Member):
            names = sorted(variables(q) - bound)
            none = self._one(out).where(F.lit(False))
            for n in names:
                none = none.withColumn(_v(n), F.lit(None).cast("string"))
            return True, none, bound | set(names)
        raise RuleError(f"unsupported condition {p}")


def head(body: DataFrame, target) -> DataFrame:
    """Tuples that a frame (s, p, o for every slot) or an atom (a0, a1, ...) gets from bindings."""
    if isinstance(target, Frame):
        rows = [body.select(_term(target.subject).alias("s"), _term(p).alias("p"), _term(o).alias("o")) for p, o in target.slots]
        return reduce(DataFrame.union, rows)
    if not target.args:
        return body.limit(1).select(F.lit(True).alias("a0"))
    return body.select(*[_term(a).alias(f"a{k}") for k, a in enumerate(target.args)])

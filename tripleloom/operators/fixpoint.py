"""Rules to a fixpoint.

Programs without retraction run semi-naive: in each round every rule is evaluated once for
each body pattern that has new rows, with the new rows in that pattern and all rows in the
others; what a round derives is made distinct, freed of known rows by an anti-join and
written to the shared folder, which cuts the lineage and lets a round survive a lost
executor. Patterns whose constant predicate got nothing new are skipped: one aggregation
over the new rows tells, bounded by the constants of the program. The same counts decide
joins: the triples of a constant predicate (a schema pattern) are broadcast as long as they
are at most ``SMALL`` in all, and a round whose heads have constant predicates looks for
known rows among those predicates alone. Relations over lists come from
:mod:`tripleloom.operators.lists`, renewed when triples that they rest on are new.

They run until a round derives nothing new, however many it takes.

Programs with retraction run one rule at a time, retracts before asserts, until a whole
cycle changes nothing. They need not end, so ``max_iter`` cycles without such an end are an
error (``NoFixpoint``), never a result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.ast import ERROR, And, Atom, Const, Frame, Rule
from ..plans.check import check, has_retraction, strata
from ..plans.compile import BUILTINS, Compiler, _args, disjuncts, head, patterns
from ..scratch import Scratch
from . import lists

TRIPLE = ["s", "p", "o"]
#: Triples of a constant predicate up to which a pattern is broadcast; counted, not estimated.
SMALL = 50_000
#: Written tables of a relation, one a round, after which all but the first are written as one.
PARTS = 12


class NoFixpoint(RuntimeError):
    """A program with retraction still changes rows after ``max_iter`` cycles."""


@dataclass
class Closure:
    """Result: all triples, auxiliary relations, the inconsistency flag, counters by round."""

    triples: DataFrame
    relations: dict[str, DataFrame]
    inconsistent: bool
    rounds: int
    metrics: list[dict] = field(default_factory=list)

    def valid(self) -> DataFrame:
        """Triples that RDF allows: no literal subject, IRI predicates."""
        return self.triples.where(~F.col("s").startswith('"') & F.col("p").startswith("<"))


def _columns(name: str, arity: int) -> list[str]:
    return TRIPLE if name == "T" else [f"a{k}" for k in range(max(1, arity))]


def _empty(spark: SparkSession, name: str, arity: int) -> DataFrame:
    kind = "boolean" if name != "T" and arity == 0 else "string"
    return spark.createDataFrame([], ", ".join(f"{c} {kind}" for c in _columns(name, arity)))


class Engine:
    def __init__(self, triples: DataFrame, rules: list[Rule], builtins=None, reference_facts: bool = False, max_iter: int = 200, relations: dict[str, DataFrame] | None = None, delta: DataFrame | None = None):
        self.spark = triples.sparkSession
        self.builtins = BUILTINS if builtins is None else builtins
        check(rules, self.builtins)
        self.delta = delta
        if delta is not None and (has_retraction(rules) or any(isinstance(a.target, Atom) and a.target.name != ERROR for r in rules for a in r.actions)):
            raise ValueError("only programs of triples alone, without retraction, go on from a closure")
        self.facts = [] if reference_facts else [r for r in rules if r.body == And()]
        self.rules = [r for r in rules if r.body != And()]
        self.max_iter, self.scratch = max_iter, Scratch(self.spark, "closure")
        self.start = {"T": triples.select(*TRIPLE)} | (relations or {})
        self.arity = {"T": 3}
        for r in rules:
            for d in disjuncts(r.body):
                for p in patterns(And(tuple(d))):
                    name, args, _ = _args(p)
                    self.arity[name] = len(args)
            for a in r.actions:
                if isinstance(a.target, Atom):
                    self.arity[a.target.name] = len(a.target.args)
        asserted = {a.target.name for r in rules for a in r.actions if isinstance(a.target, Atom)}
        self.lists = [n for n in lists.RELATIONS if n in self.arity and n not in asserted and n not in self.start]
        self.cells, self.places, self.counts = None, {}, {}
        for r in self.facts:
            for a in r.actions:
                one = head(self.spark.range(1).select(), a.target)
                name = a.target.name if isinstance(a.target, Atom) else "T"
                self.start[name] = self.start[name].unionByName(one) if name in self.start else one

    def run(self) -> Closure:
        return self._cycle() if has_retraction(self.rules) else self._semi_naive()

    # -- semi-naive ---------------------------------------------------------------------

    def _semi_naive(self) -> Closure:
        used = [p for r in self.rules for d in disjuncts(r.body) for p in patterns(And(tuple(d))) if isinstance(p, Frame)]
        constants = sorted({p.slots[0][0].term for p in used if isinstance(p.slots[0][0], Const)})
        objects = sorted({p.slots[0][1].term for p in used if isinstance(p.slots[0][0], Const) and isinstance(p.slots[0][1], Const)})
        if self.lists:
            constants = sorted({*constants, lists.TYPE, lists.FIRST, lists.REST, *lists.ABOUT.values()})
        present: set = set()
        full, metrics, rounds = {}, [], 0
        for name, df in self.start.items():
            full[name] = [self.scratch.table(df.distinct())]
        live = self._live({n: self._all(full, n) for n in full}, constants, objects)
        if self.delta is not None:  # the start is closed already, but for these
            fresh = self.scratch.table(self.delta.select(*TRIPLE).distinct().join(full["T"][0], TRIPLE, "left_anti"))
            present, live = live, self._live({"T": fresh}, constants, objects)
            self._add(full, {"T": fresh})
        self._add(full, self._list_rows(full, full, live | present))
        for layer in strata(self.rules):
            new = {n: self._all(full, n) for n in full}
            if self.delta is not None:
                new["T"] = fresh
            while True:
                present |= live
                derived, into = self._round(layer, full, new, live, present)
                rounds += 1
                fresh = {}
                for name, parts in derived.items():
                    cols = _columns(name, self.arity[name])
                    made = reduce(DataFrame.unionByName, parts).distinct()
                    if name in full:
                        known = self._all(full, name)
                        if name == "T" and None not in into:
                            known = known.where(F.col("p").isin(sorted(into)))
                        made = made.join(known, cols, "left_anti")
                    made = self.scratch.table(made.select(*cols))
                    if not made.isEmpty():
                        fresh[name] = made
                self._add(full, fresh)
                live = self._live(fresh, constants, objects)
                more = self._list_rows(full, fresh, live) if "T" in fresh else {}
                self._add(full, more)
                fresh |= more
                metrics.append({"round": rounds, "relations": {n: d.count() for n, d in fresh.items()}, "variants": sum(len(p) for p in derived.values())})
                new = fresh
                if not fresh:
                    break
            live = set(present)
        done = {n: self._all(full, n) for n in full}
        bad = ERROR in done and not done[ERROR].isEmpty()
        return Closure(done.pop("T"), done, bad, rounds, metrics)

    def _add(self, full, fresh) -> None:
        for name, df in fresh.items():
            parts = full.setdefault(name, [])
            parts.append(df)
            if len(parts) > PARTS:
                full[name] = [parts[0], self.scratch.table(reduce(DataFrame.unionByName, parts[1:]))]

    def _list_rows(self, full, new, live) -> dict[str, DataFrame]:
        """New rows of the relations over lists; ``new`` and ``live`` are the triples since the last call."""
        if not self.lists:
            return {}
        triples, out = self._all(full, "T"), {}
        changed = lists.FIRST in live or lists.REST in live
        if changed:
            self.cells = lists.unfold(triples, self.scratch)
        if self.cells is None:
            return {}
        for name in self.lists:
            if name != "item":
                moved = changed or lists.ABOUT[name] in live
                if moved or name not in self.places:
                    self.places[name] = lists.members(self.cells, triples, name, self.scratch)
                moved |= name != "path" and lists.TYPE in live
                if not moved and name != "has_all":
                    fresh = new["T"] if isinstance(new["T"], DataFrame) else self._all(new, "T")
                    moved = not fresh.join(lists._small(self.places[name]), F.col("p") == F.col("x"), "left_semi").isEmpty()
                if not moved:
                    continue
            elif not changed:
                continue
            made = lists.derive(name, self.cells, self.places.get(name), triples, self.scratch)
            if name in full:
                made = made.join(self._all(full, name), made.columns, "left_anti")
            made = self.scratch.table(made)
            if not made.isEmpty():
                out[name] = made
        return out

    def _all(self, full, name) -> DataFrame:
        parts = full.get(name)
        return reduce(DataFrame.unionByName, parts) if parts else _empty(self.spark, name, self.arity[name])

    def _live(self, new, constants, objects) -> set:
        """Constant predicates, and (predicate, object) pairs of constants, that the new triples have; bounded by the program."""
        if "T" not in new or not constants:
            return set()
        o = F.when(F.col("o").isin(objects), F.col("o")) if objects else F.lit(None).cast("string")
        rows = new["T"].where(F.col("p").isin(constants)).groupBy("p", o.alias("o")).count().collect()
        for r in rows:
            self.counts[r["p"]] = self.counts.get(r["p"], 0) + r["count"]
        return {r["p"] for r in rows} | {(r["p"], r["o"]) for r in rows if r["o"] is not None}

    def _round(self, rules, full, new, live, present) -> tuple[dict[str, list[DataFrame]], set]:
        """(rows by relation, predicates of the triples among them; None stands for any)."""
        out: dict[str, list[DataFrame]] = {}
        into: set = set()
        for r in rules:
            for d in disjuncts(r.body):
                found = patterns(And(tuple(d)))
                if not all(self._has(p, full, present) for p in found):
                    continue  # a pattern without a row: no match in any variant
                first = [k for k, p in enumerate(found) if self._has(p, new, live)]
                if not found:  # equalities and lists alone: once
                    first = [None]
                for k in first:
                    def relation(name, arity, at, p, k=k):
                        rows = new[name] if at == k else self._all(full, name)
                        pred = p.slots[0][0] if name == "T" else None
                        if isinstance(pred, Const) and self.counts.get(pred.term, SMALL + 1) <= SMALL:
                            return F.broadcast(rows.where(F.col("p") == pred.term))
                        return rows

                    body = Compiler(relation, self.builtins).conjunction(d)
                    for a in r.actions:
                        name = a.target.name if isinstance(a.target, Atom) else "T"
                        if name == "T":
                            into |= {p.term if isinstance(p, Const) else None for p, _ in a.target.slots}
                        out.setdefault(name, []).append(head(body, a.target))
        return out, into

    @staticmethod
    def _has(p, relations, known) -> bool:
        if isinstance(p, Atom):
            return p.name in relations
        pred, obj = p.slots[0]
        if "T" not in relations or not isinstance(pred, Const):
            return "T" in relations
        return ((pred.term, obj.term) if isinstance(obj, Const) else pred.term) in known

    # -- retraction ---------------------------------------------------------------------

    def _cycle(self) -> Closure:
        now = {n: self.scratch.table(df.distinct()) for n, df in self.start.items()}
        metrics, rounds, still, k = [], 0, 0, 0
        while still < len(self.rules):
            if k == self.max_iter * len(self.rules):
                raise NoFixpoint(f"no fixpoint after {self.max_iter} cycles of {len(self.rules)} rules")
            r = self.rules[k % len(self.rules)]
            k += 1
            rounds += 1
            if needed := [n for n in self.lists if any(_args(p)[0] == n for d in disjuncts(r.body) for p in patterns(And(tuple(d))))]:
                cells = lists.unfold(now["T"], self.scratch)
                for n in needed:
                    now[n] = self.scratch.table(lists.derive(n, cells, lists.members(cells, now["T"], n, self.scratch) if n != "item" else None, now["T"], self.scratch))
            body = Compiler(lambda name, arity, at, p: now.get(name) if name in now else _empty(self.spark, name, self.arity[name]), self.builtins).condition(r.body)
            body = self.scratch.table(body) if body.columns else body
            changed = 0
            for verb in ("Retract", "Assert"):
                for a in r.actions:
                    if a.verb != verb:
                        continue
                    name = a.target.name if isinstance(a.target, Atom) else "T"
                    cols = _columns(name, self.arity[name])
                    made = head(body, a.target).distinct()
                    have = now.get(name)
                    if verb == "Retract" and have is None:
                        continue
                    if verb == "Retract":
                        gone = self.scratch.table(made.join(have, cols, "left_semi"))
                        n = gone.count()
                        if n:
                            now[name] = self.scratch.table(have.join(gone, cols, "left_anti"))
                    else:
                        more = self.scratch.table(made.join(have, cols, "left_anti").select(*cols) if have is not None else made.select(*cols))
                        n = more.count()
                        if n:
                            now[name] = self.scratch.table(have.unionByName(more)) if have is not None else more
                    changed += n
            metrics.append({"round": rounds, "rule": r.name or str(r), "changed": changed})
            still = 0 if changed else still + 1
        bad = ERROR in now and not now[ERROR].isEmpty()
        triples = now.pop("T")
        return Closure(triples, now, bad, rounds, metrics)


def closure(triples: DataFrame, rules: list[Rule], **options) -> Closure:
    """All triples and relations that ``rules`` derive from ``triples`` (s, p, o in canonical form).

    With ``delta``, ``triples`` are a closure of ``rules`` already, and only what the new triples add is worked out.
    """
    return Engine(triples, rules, **options).run()


def matches(triples: DataFrame, rule: Rule, relations: dict[str, DataFrame] | None = None) -> DataFrame:
    """Distinct bindings of a rule's body over ``triples``: a column for each variable."""
    engine = Engine(triples, [rule], relations=relations)
    have = dict(engine.start)
    if engine.lists:
        cells = lists.unfold(have["T"], engine.scratch)
        for n in engine.lists:
            have[n] = lists.derive(n, cells, None if n == "item" else lists.members(cells, have["T"], n, engine.scratch), have["T"], engine.scratch)
    body = Compiler(lambda name, arity, at, p: have[name] if name in have else _empty(engine.spark, name, engine.arity[name]), engine.builtins).condition(rule.body)
    return body.select(*[F.col(c).alias(c[2:]) for c in body.columns]).distinct()


def firings(triples: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, n: how many bindings match each rule, rules without a match included."""
    each = [matches(triples, r).agg(F.count("*").alias("n")).select(F.lit(r.name or str(r)).alias("rule"), "n") for r in rules]
    return reduce(DataFrame.unionByName, each).groupBy("rule").agg(F.sum("n").alias("n"))

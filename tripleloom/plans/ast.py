"""Syntax trees of production rules."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self):
        return f"?{self.name}"


@dataclass(frozen=True)
class Const:
    """A constant in canonical N-Triples form."""

    term: str

    def __str__(self):
        return self.term


@dataclass(frozen=True)
class ListTerm:
    items: tuple

    def __str__(self):
        return f"List({' '.join(map(str, self.items))})"


@dataclass(frozen=True)
class Frame:
    """``s[p1->o1 p2->o2]``."""

    subject: object
    slots: tuple

    def __str__(self):
        return f"{self.subject}[{' '.join(f'{p}->{o}' for p, o in self.slots)}]"


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple

    def __str__(self):
        return f"{self.name}({' '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Equal:
    left: object
    right: object

    def __str__(self):
        return f"{self.left} = {self.right}"


@dataclass(frozen=True)
class Member:
    """``a # b``, or ``a ## b`` where ``sub``: read, and true of nothing."""

    left: object
    right: object
    sub: bool = False

    def __str__(self):
        return f"{self.left} {'##' if self.sub else '#'} {self.right}"


@dataclass(frozen=True)
class External:
    name: str
    args: tuple

    def __str__(self):
        return f"External({self.name}({' '.join(map(str, self.args))}))"


@dataclass(frozen=True)
class Not:
    body: object

    def __str__(self):
        return f"Not({self.body})"


@dataclass(frozen=True)
class And:
    parts: tuple = ()

    def __str__(self):
        return f"And({' '.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Or:
    parts: tuple = ()

    def __str__(self):
        return f"Or({' '.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Exists:
    names: tuple
    body: object

    def __str__(self):
        return f"Exists {' '.join(f'?{n}' for n in self.names)} ({self.body})"


@dataclass(frozen=True)
class Action:
    """``verb`` is Assert, Retract, Modify or Execute."""

    verb: str
    target: object

    def __str__(self):
        return f"{self.verb}({self.target})"


@dataclass(frozen=True)
class Rule:
    body: object
    actions: tuple
    name: str = ""

    def __str__(self):
        return f"If {self.body} Then Do({' '.join(map(str, self.actions))})"


@dataclass(frozen=True)
class Pragma:
    """``#PRAGMA [NOT] REPLICATE|ARBITRARY condition``."""

    what: str
    condition: object
    negated: bool = False


@dataclass
class Program:
    rules: list = field(default_factory=list)
    pragmas: list = field(default_factory=list)
    prefixes: dict = field(default_factory=dict)


#: The 0-ary relation that marks an inconsistency.
ERROR = "rif:error"


def conjuncts(c) -> list:
    """Parts of nested conjunctions, in order."""
    return [x for p in c.parts for x in conjuncts(p)] if isinstance(c, And) else [c]


def variables(x) -> set[str]:
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, (ListTerm,)):
        return set().union(*map(variables, x.items)) if x.items else set()
    if isinstance(x, Frame):
        return variables(x.subject).union(*[variables(p) | variables(o) for p, o in x.slots])
    if isinstance(x, (Atom, External)):
        return set().union(*map(variables, x.args)) if x.args else set()
    if isinstance(x, (Equal, Member)):
        return variables(x.left) | variables(x.right)
    if isinstance(x, (And, Or)):
        return set().union(*map(variables, x.parts)) if x.parts else set()
    if isinstance(x, Not):
        return variables(x.body)
    if isinstance(x, Exists):
        return variables(x.body) - set(x.names)
    if isinstance(x, Action):
        return variables(x.target)
    if isinstance(x, Rule):
        return variables(x.body).union(*map(variables, x.actions))
    return set()


def is_ground(x) -> bool:
    return not variables(x)


def arity(x) -> int:
    return len(x.args) if isinstance(x, (Atom, External)) else 2 * len(x.slots) + 1 if isinstance(x, Frame) else 2


def children(x) -> tuple:
    """The direct parts of a term, formula, action or rule."""
    if isinstance(x, ListTerm):
        return x.items
    if isinstance(x, Frame):
        return (x.subject, *(y for slot in x.slots for y in slot))
    if isinstance(x, (Atom, External)):
        return x.args
    if isinstance(x, (Equal, Member)):
        return (x.left, x.right)
    if isinstance(x, (And, Or)):
        return x.parts
    if isinstance(x, (Not, Exists)):
        return (x.body,)
    if isinstance(x, Action):
        return (x.target,)
    return (x.body, *x.actions) if isinstance(x, Rule) else ()


def part(x, k: int):
    """The k-th direct part, from 0."""
    return children(x)[k]


def contains_function(x) -> bool:
    """Whether an external function stands where a term does (not as a formula of its own)."""
    if isinstance(x, (And, Or, Not, Exists, Action, Rule)):
        return any(map(contains_function, children(x)))
    return any(isinstance(y, External) or contains_function(y) for y in children(x))


def without_slot(frame: Frame, predicate) -> Frame:
    """A frame without the slots of a predicate."""
    return Frame(frame.subject, tuple(s for s in frame.slots if s[0] != predicate))


def order_key(x) -> tuple:
    """A total order of syntax trees: by kind, then by text."""
    kinds = (Var, Const, ListTerm, Frame, Atom, Equal, Member, External, Not, And, Or, Exists, Action, Rule)
    return (kinds.index(type(x)), str(x))


def normalize(x):
    """The same condition in one shape: nested conjunctions and disjunctions made flat, of one part made that part, without
    repeats, parts in order; slots of a frame in order; the smaller side of an equality first; no double negation."""
    if isinstance(x, (And, Or)):
        parts = []
        for p in map(normalize, x.parts):
            parts += p.parts if type(p) is type(x) else [p]
        parts = sorted(dict.fromkeys(parts), key=order_key)
        return parts[0] if len(parts) == 1 else type(x)(tuple(parts))
    if isinstance(x, Not):
        inner = normalize(x.body)
        return inner.body if isinstance(inner, Not) else Not(inner)
    if isinstance(x, Exists):
        return Exists(tuple(sorted(x.names)), normalize(x.body))
    if isinstance(x, Equal):
        return Equal(*sorted((x.left, x.right), key=order_key))
    if isinstance(x, Frame):
        return Frame(x.subject, tuple(sorted(dict.fromkeys(x.slots), key=lambda s: (order_key(s[0]), order_key(s[1])))))
    return Rule(normalize(x.body), x.actions, x.name) if isinstance(x, Rule) else x

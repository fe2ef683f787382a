"""Programs as recursive SQL: an independent statement of what a closure must be.

Every rule is a join over the table of all triples so far; the recursion ends when no rule
gives a new triple. This is naive evaluation, for tests and checks on small graphs (the
dialect is DuckDB's, whose recursion can read the whole table). Programs may use frames,
inequality, the two literal builtins, ``item`` over lists that are there from the start, and
heads that are frames; errors are left out, as they add no triple.
"""

from __future__ import annotations

from .ast import ERROR, And, Atom, Const, Equal, External, Frame, Not, Rule, conjuncts
from .parser import PREFIXES, RuleError

_FIRST, _REST = (f"<{PREFIXES['rdf']}{n}>" for n in ("first", "rest"))
_XML = f"^^<{PREFIXES['rdf']}XMLLiteral>"
_BUILTINS = {
    "pred:is-literal-XMLLiteral": lambda x: f"ends_with({x}, '{_XML}')",
    "pred:is-literal-PlainLiteral": lambda x: f"(starts_with({x}, '\"') AND NOT regexp_matches({x}, '\"\\^\\^<[^>]*>$'))",
}


_ITEMS = f"""cells(l, c) AS (SELECT s, s FROM base WHERE p = '{_FIRST}' UNION SELECT cells.l, b.o FROM cells JOIN base b ON b.s = cells.c AND b.p = '{_REST}'),
items AS (SELECT DISTINCT cells.l AS l, b.o AS x FROM cells JOIN base b ON b.s = cells.c AND b.p = '{_FIRST}')"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _body(rule: Rule, table: str):
    """(FROM and WHERE of a rule's body, its variables with their columns, the SQL of a term)."""
    sources, tests, where = [], [], {}

    def term(x):
        return _quote(x.term) if isinstance(x, Const) else where[x.name]

    def meet(column, x):
        if isinstance(x, Const):
            tests.append(f"{column} = {_quote(x.term)}")
        elif x.name in where:
            tests.append(f"{column} = {where[x.name]}")
        else:
            where[x.name] = column

    parts = conjuncts(rule.body)
    for p in parts:
        if isinstance(p, Frame):
            for pred, obj in p.slots:
                sources.append(f"{table} x{len(sources)}")
                for c, x in zip("spo", (p.subject, pred, obj)):
                    meet(f"x{len(sources) - 1}.{c}", x)
        elif isinstance(p, Atom) and p.name == "item":
            sources.append(f"items x{len(sources)}")
            for c, x in zip("lx", p.args):
                meet(f"x{len(sources) - 1}.{c}", x)
    for p in parts:
        if isinstance(p, Not) and isinstance(p.body, Equal):
            tests.append(f"{term(p.body.left)} <> {term(p.body.right)}")
        elif isinstance(p, Not) and isinstance(p.body, External) and p.body.name == "pred:list-contains":
            items, x = p.body.args
            tests.append(f"{term(x)} NOT IN ({', '.join(_quote(i.term) for i in items.items)})")
        elif isinstance(p, External) and p.name in _BUILTINS:
            tests.append(_BUILTINS[p.name](term(p.args[0])))
        elif not isinstance(p, Frame) and not (isinstance(p, Atom) and p.name == "item"):
            raise RuleError(f"no SQL for {p}")
    return (f" FROM {', '.join(sources)}" if sources else "") + (f" WHERE {' AND '.join(tests)}" if tests else ""), where, term


def rule_sql(rule: Rule, table: str = "recurring.t") -> list[str]:
    """One SELECT of s, p, o for each triple that a rule's head makes; none for an error."""
    body, _, term = _body(rule, table)
    out = []
    for a in rule.actions:
        if isinstance(a.target, Atom):
            if a.target.name == ERROR:
                continue
            raise RuleError(f"no SQL for {a}")
        for pred, obj in a.target.slots:
            out.append(f"SELECT {term(a.target.subject)} AS s, {term(pred)} AS p, {term(obj)} AS o{body}")
    return out


def program_sql(rules: list[Rule], base: str) -> str:
    """All triples that ``rules`` derive from the rows (s, p, o) of the query ``base``."""
    facts = [q for r in rules if r.body == And() for q in rule_sql(r)]
    steps = [q for r in rules if r.body != And() for q in rule_sql(r)]
    return f"""WITH RECURSIVE base AS (SELECT s, p, o FROM ({base}) UNION {" UNION ".join(facts) if facts else "SELECT s, p, o FROM (" + base + ")"}),
{_ITEMS},
t(s, p, o) USING KEY (s, p, o) AS (
SELECT s, p, o FROM base
UNION
(SELECT s, p, o FROM (
{chr(10).join(("UNION " if k else "") + q for k, q in enumerate(steps))}
) EXCEPT SELECT s, p, o FROM recurring.t))
SELECT s, p, o FROM t"""



def firings_sql(rules: list[Rule], base: str) -> str:
    """rule, n: how many distinct bindings over the rows of ``base`` match each rule."""
    parts = []
    for r in rules:
        body, where, _ = _body(r, "base")
        parts.append(f"SELECT {_quote(r.name or str(r))} AS rule, count(*) AS n FROM (SELECT DISTINCT {', '.join(where[v] + ' AS v_' + v for v in sorted(where))}{body})")
    return f"WITH RECURSIVE base AS (SELECT s, p, o FROM ({base})),\n{_ITEMS}\nSELECT rule, CAST(sum(n) AS BIGINT) AS n FROM (\n" + "\nUNION ALL ".join(parts) + "\n) GROUP BY rule"

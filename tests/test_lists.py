"""Relations over lists against walking the lists in Python."""

import itertools
import random

from tripleloom.operators import lists
from tripleloom.operators.fixpoint import closure
from tripleloom.plans import programs
from tripleloom.plans.parser import parse
from tripleloom.scratch import Scratch

RDF, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2002/07/owl#"
TYPE, FIRST, REST, NIL = (f"<{RDF}{n}>" for n in ("type", "first", "rest", "nil"))


def graph(spark, rows):
    return spark.createDataFrame(list(rows), "s string, p string, o string")


def as_list(name, items):
    rows = [(f"_:{name}{k}", FIRST, x) for k, x in enumerate(items)]
    return rows + [(f"_:{name}{k}", REST, f"_:{name}{k + 1}" if k + 1 < len(items) else NIL) for k in range(len(items))]


def test_a_long_list_takes_few_rounds(spark):
    n = 300
    rows = as_list("l", [f"<a:{k}>" for k in range(n)]) + [("<a:C>", f"<{OWL}oneOf>", "_:l0")]
    done = closure(graph(spark, rows), programs.pick(programs.OWL_RL, "cls-oo"))
    assert done.triples.where(f"p = '{TYPE}'").count() == n and done.rounds <= 3


def test_unfolding_numbers_places_and_marks_bad_lists(spark):
    rows = as_list("a", ["<x:1>", "<x:2>", "<x:1>"]) + [("<h:1>", "<p:p>", "_:a0"), ("<h:2>", "<p:p>", "_:a1")]
    rows += [("_:c0", FIRST, "<x:7>"), ("_:c0", REST, "_:c1"), ("_:c1", FIRST, "<x:8>"), ("_:c1", REST, "_:c0"), ("<h:3>", "<p:p>", "_:c0")]
    rows += [("_:d0", FIRST, "<x:9>"), ("<h:4>", "<p:p>", "_:d0")]
    got = {(r["l"], r["k"], r["x"], r["good"]) for r in lists.unfold(graph(spark, rows), Scratch(spark, "t")).collect()}
    assert {g for g in got if g[0][2] == "a"} == {("_:a0", 0, "<x:1>", True), ("_:a0", 1, "<x:2>", True), ("_:a0", 2, "<x:1>", True), ("_:a1", 0, "<x:2>", True), ("_:a1", 1, "<x:1>", True)}
    assert {(x, g) for l, _, x, g in got if l == "_:c0"} == {("<x:7>", False), ("<x:8>", False)} and {(x, g) for l, _, x, g in got if l == "_:d0"} == {("<x:9>", False)}
    assert lists.unfold(graph(spark, []), Scratch(spark, "t")).count() == 0


def test_list_rules_equal_walking_the_lists(spark):
    rnd = random.Random(11)
    things, classes, props = [f"<i:{k}>" for k in range(12)], [f"<c:{k}>" for k in range(4)], [f"<p:{k}>" for k in range(3)]
    types = {(x, c) for x in things for c in classes if rnd.random() < 0.6}
    links = {(rnd.choice(things), rnd.choice(props), rnd.choice(things)) for _ in range(50)}
    rows = {(x, TYPE, c) for x, c in types} | links
    both, chain, key = classes[:3], [props[0], props[1], props[0], props[2], props[1], props[0]], props[:2]
    rows |= set(as_list("i", both)) | set(as_list("c", chain)) | set(as_list("k", key))
    rows |= {("<x:All>", f"<{OWL}intersectionOf>", "_:i0"), ("<x:far>", f"<{OWL}propertyChainAxiom>", "_:c0"), (classes[3], f"<{OWL}hasKey>", "_:k0")}
    done = closure(graph(spark, rows), programs.pick(programs.OWL_RL, "cls-int1", "prp-spo2", "prp-key"))
    got = {tuple(r) for r in done.triples.collect()} - rows
    want = {(x, TYPE, "<x:All>") for x in things if all((x, c) in types for c in both)}
    ends = {(x, x) for x in things}
    for p in chain:
        ends = {(x, o) for x, y in ends for s, q, o in links if s == y and q == p}
    want |= {(x, "<x:far>", y) for x, y in ends}
    values = {(x, p): {o for s, q, o in links if s == x and q == p} for x in things for p in key}
    mine = [x for x in things if (x, classes[3]) in types]
    want |= {(x, f"<{OWL}sameAs>", y) for x, y in itertools.permutations(mine, 2) if all(values[x, p] & values[y, p] for p in key)}
    assert got == want and any(p == f"<{OWL}sameAs>" for _, p, _ in want) and len(want) > 10


def test_lists_grow_with_the_closure(spark):
    """A chain over a derived property, a list that a rule makes, and a program with retraction."""
    rows = as_list("c", ["<p:q>", "<p:q>"]) + [("<x:far>", f"<{OWL}propertyChainAxiom>", "_:c0"), ("<p:p>", f"<http://www.w3.org/2000/01/rdf-schema#subPropertyOf>", "<p:q>"), ("<i:1>", "<p:p>", "<i:2>"), ("<i:2>", "<p:p>", "<i:3>")]
    done = closure(graph(spark, rows), programs.pick(programs.OWL_RL, "prp-spo1", "prp-spo2"))
    assert done.triples.where("p = '<x:far>'").collect() == [("<i:1>", "<x:far>", "<i:3>")]
    made = parse(f"?x[<{RDF}first>-><a:m>] :- And(?x[<a:is>-><a:cell>])\n?x[<a:has>->?m] :- And(?y[<a:list>->?x] item(?x ?m))").rules
    rows = [("_:z", "<a:is>", "<a:cell>"), ("_:z", REST, NIL), ("<a:o>", "<a:list>", "_:z")]
    assert closure(graph(spark, rows), made).triples.where("p = '<a:has>'").collect() == [("_:z", "<a:has>", "<a:m>")]
    cut = parse("If And(?y[<a:list>->?x] item(?x ?m)) Then Do(Retract(?y[<a:list>->?x]) Assert(?y[<a:had>->?m]))").rules
    got = closure(graph(spark, [*rows, ("_:z", FIRST, "<a:m>")]), cut).triples
    assert got.where("p = '<a:had>'").count() == 1 and got.where("p = '<a:list>'").count() == 0


def test_a_long_chain_is_closed_to_its_end(spark):
    n = 300
    rows = [(f"<i:{k}>", "<p:p>", f"<i:{k + 1}>") for k in range(n)] + [("<p:p>", TYPE, f"<{OWL}TransitiveProperty>")]
    done = closure(graph(spark, rows), programs.pick(programs.OWL_RL, "prp-trp"), max_iter=2)
    assert done.triples.where("p = '<p:p>'").count() == n * (n + 1) // 2


def test_a_closure_goes_on_from_new_triples(spark):
    rnd = random.Random(4)
    sub, far = "<http://www.w3.org/2000/01/rdf-schema#subPropertyOf>", f"<{OWL}propertyChainAxiom>"
    rows = [(f"<i:{rnd.randrange(12)}>", f"<p:{rnd.randrange(3)}>", f"<i:{rnd.randrange(12)}>") for _ in range(40)]
    rows += [("<p:0>", sub, "<p:1>"), ("<p:2>", TYPE, f"<{OWL}TransitiveProperty>"), ("<x:far>", far, "_:c0"), *as_list("c", ["<p:1>", "<p:2>"])]
    rnd.shuffle(rows)
    rules = programs.pick(programs.OWL_RL, "prp-spo1", "prp-trp", "prp-spo2", "prp-dom")
    whole = {tuple(r) for r in closure(graph(spark, rows), rules).triples.collect()}
    for cut in (10, 30):
        first = closure(graph(spark, rows[:cut]), rules).triples
        assert {tuple(r) for r in closure(first, rules, delta=graph(spark, rows[cut:])).triples.collect()} == whole

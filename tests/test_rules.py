"""Parser, checks, compiler and fixpoints, the last against a small evaluator in Python."""

import random

import pytest

from tripleloom.operators.fixpoint import NoFixpoint, closure
from tripleloom.plans import ast, placement, programs
from tripleloom.plans.ast import And, Atom, Const, Equal, Frame, Not, Var, conjuncts, is_ground
from tripleloom.plans.check import check, strata
from tripleloom.plans.compile import BUILTINS
from tripleloom.plans.parser import RuleError, parse, parse_condition, rif_constant

XSD = "http://www.w3.org/2001/XMLSchema#"


def graph(spark, rows):
    return spark.createDataFrame(list(rows), "s string, p string, o string")


def naive(triples, rules):
    """All triples, by trying every match again until nothing is new (relations as ('@name', args))."""
    facts = {("T", *t) for t in triples}

    def match(args, row, env):
        env = dict(env)
        for a, v in zip(args, row):
            want = a.term if isinstance(a, Const) else env.setdefault(a.name, v)
            if want != v:
                return None
        return env

    def value(x, env):
        return x.term if isinstance(x, Const) else env[x.name]

    while True:
        new = set()
        for r in rules:
            envs = [{}]
            for p in conjuncts(r.body):
                if isinstance(p, Frame):
                    for q, o in p.slots:
                        envs = [e for env in envs for f in facts if f[0] == "T" if (e := match([p.subject, q, o], f[1:], env)) is not None]
                elif isinstance(p, Atom):
                    envs = [e for env in envs for f in facts if f[0] == p.name if (e := match(p.args, f[1:], env)) is not None]
            for p in conjuncts(r.body):
                if isinstance(p, Not):
                    envs = [e for e in envs if value(p.body.left, e) != value(p.body.right, e)]
            for env in envs:
                for a in r.actions:
                    if isinstance(a.target, Frame):
                        new |= {("T", value(a.target.subject, env), value(q, env), value(o, env)) for q, o in a.target.slots}
                    else:
                        new.add((a.target.name, *[value(x, env) for x in a.target.args]))
        if new <= facts:
            return {f[1:] for f in facts if f[0] == "T"}
        facts |= new


def test_parse_prints_in_canonical_form():
    p = parse("""
Prefix(e <http://e/>)
#DEFINE kind rdf:type
#PRAGMA NOT REPLICATE And(?x[rdfs:subClassOf->?y])
# a comment
(* <#one> *)
Forall ?x ?c (
  ?x[{kind}->e:B]  :-  And( ?x[{kind}->?c]
# a comment inside
     Not(?c = e:B) External(pred:list-contains(List(e:A "v"@en 1) ?c)) )
)
e:a[rdf:type->e:A]
If And(e:p(?x "t"^^xsd:int)) Then Do(Assert(?x[e:q->"a"]) Retract(?x[e:z->1]))
rif:error() :- And(?x[e:q->?x])""")
    assert [r.name for r in p.rules][:1] == ["<#one>"]
    assert len(p.rules) == 4 and p.rules[1].body == And() and p.pragmas[0].negated
    assert "List(<http://e/A> \"v\"@en \"1\"^^<" + XSD + "integer>)" in str(p.rules[0])
    assert [a.verb for a in p.rules[2].actions] == ["Assert", "Retract"]
    assert is_ground(p.rules[1].actions[0].target)
    assert str(parse_condition("And( ?x[ <http://e/p> -> ?y ]   ?x = ?y )")) == "And(?x[<http://e/p>->?y] ?x = ?y)"


@pytest.mark.parametrize(
    "lex, dt, out",
    [
        ("http://e/x", "http://www.w3.org/2007/rif#iri", "<http://e/x>"),
        ("a", XSD + "string", '"a"'),
        ("a@en", "http://www.w3.org/1999/02/22-rdf-syntax-ns#PlainLiteral", '"a"@en'),
        ("a@", "http://www.w3.org/1999/02/22-rdf-syntax-ns#PlainLiteral", '"a"'),
        ("0", XSD + "integer", f'"0"^^<{XSD}integer>'),
    ],
)
def test_constants(lex, dt, out):
    assert rif_constant(lex, dt) == out


@pytest.mark.parametrize("text", ["p(?y) :- And(?x[rdf:type->?x])", "If And(p(?x)) Then Do(Modify(p(?x)))", "p(?x) :- And(p(?x) p(?x ?x))", "p(?x) :- And(Not(p(?x)))"])
def test_checks_refuse(text):
    with pytest.raises(RuleError):
        check(parse(text).rules, BUILTINS)


def test_syntax_trees():
    c = parse_condition('And(?x[<a:p>->?y <a:q>->"1"] And(?y = ?x Or(Not(Not(?x = <a:1>)))) ?y = ?x Exists ?b ?a (?a[<a:p>->?b]))')
    flat = ast.normalize(c)
    assert str(flat) == 'And(?x[<a:p>->?y <a:q>->"1"] ?x = <a:1> ?x = ?y Exists ?a ?b (?a[<a:p>->?b]))' and ast.normalize(flat) == flat
    f = conjuncts(c)[0]
    assert str(ast.without_slot(f, Const("<a:p>"))) == '?x[<a:q>->"1"]' and ast.part(f, 2) == Var("y") and ast.arity(f) == 5
    assert not ast.contains_function(c) and ast.contains_function(Equal(Var("x"), ast.External("func:f", (Var("y"),))))
    assert sorted([Equal(Var("x"), Var("y")), Var("b"), Var("a"), Const("<a>")], key=ast.order_key)[:2] == [Var("a"), Var("b")]


def test_strata_put_list_walks_first():
    layers = strata(programs.rules("""
a: up(?x) <= low(?x)
b: low(?x) <= ?x rdf:type ?y
"""))
    assert [r.name for layer in layers for r in layer] == ["b", "a"]


def test_random_programs_agree_with_a_naive_evaluator(spark):
    rnd = random.Random(6)
    for _ in range(3):
        nodes, preds = [f"<n:{k}>" for k in range(6)], [f"<p:{k}>" for k in range(3)]
        rows = {(rnd.choice(nodes), rnd.choice(preds), rnd.choice(nodes)) for _ in range(10)}
        text = []
        for k in range(3):
            a, b, c = (rnd.choice(preds) for _ in range(3))
            text.append(f"?x[{a}->?z] :- And(?x[{b}->?y] ?y[{c}->?z]{rnd.choice(['', ' Not(?x = ?z)'])})")
        text.append(f"seen(?x) :- And(?x[{preds[0]}->?x])")
        text.append(f"?x[{preds[2]}->?y] :- And(seen(?x) ?y[{preds[1]}->?x])")
        program = parse("\n".join(text)).rules
        got = {tuple(r) for r in closure(graph(spark, rows), program).triples.collect()}
        assert got == naive(rows, program)


def test_facts_errors_and_metrics(spark):
    rules = parse("<a:x>[<a:p>-><a:x>]\nrif:error() :- And(?x[<a:p>->?x])").rules
    none = graph(spark, [("<a:y>", "<a:q>", "<a:z>")])
    done = closure(none, rules)
    assert done.inconsistent and done.triples.count() == 2
    assert not closure(none, rules, reference_facts=True).inconsistent


def test_retraction_and_valid(spark):
    rules = parse('If And(?x[<a:p>->?y] Not(?y = "z")) Then Do(Retract(?x[<a:p>->?y]) Assert(?y[<a:q>->?x]))').rules
    done = closure(graph(spark, [("<a:1>", "<a:p>", '"v"'), ("<a:1>", "<a:p>", '"z"')]), rules)
    assert {tuple(r) for r in done.triples.collect()} == {('"v"', "<a:q>", "<a:1>"), ("<a:1>", "<a:p>", '"z"')}
    assert done.valid().count() == 1


def test_atoms_can_be_retracted(spark):
    rules = parse('If And(?x[<a:p>->?y]) Then Do(Assert(seen(?x ?y)) Retract(?x[<a:p>->?y]))\nIf And(seen(?x ?y) ?y[<a:gone>->"1"]) Then Do(Retract(seen(?x ?y)))').rules
    done = closure(graph(spark, [("<a:1>", "<a:p>", "<a:2>"), ("<a:3>", "<a:p>", "<a:4>"), ("<a:2>", "<a:gone>", '"1"')]), rules)
    assert [tuple(r) for r in done.relations["seen"].collect()] == [("<a:3>", "<a:4>")] and done.triples.count() == 1


def test_meta_modelling(spark):
    """A property below rdfs:subPropertyOf itself."""
    sub = "<http://www.w3.org/2000/01/rdf-schema#subPropertyOf>"
    rows = [("<a:m>", sub, sub), ("<a:p>", "<a:m>", "<a:q>"), ("<a:1>", "<a:p>", "<a:2>")]
    got = {tuple(r) for r in closure(graph(spark, rows), programs.MINIMAL_RDFS).triples.collect()}
    assert got == naive(rows, programs.MINIMAL_RDFS) and ("<a:1>", "<a:q>", "<a:2>") in got and len(got) == 5


def test_empty_graph(spark):
    done = closure(graph(spark, []), programs.MINIMAL_RDFS)
    assert done.triples.count() == 0 and not done.inconsistent


def test_placement():
    got = placement.advice(programs.MINIMAL_RDFS, sacrifice=True)
    assert got and all(w in ("REPLICATE", "ARBITRARY", "ABANDON") for w, _ in got)
    planner = placement.Planner(programs.pick(programs.MINIMAL_RDFS, "cax-sco"))
    assert planner.dimacs().startswith("p cnf ")
    model = planner.solve()
    assert any("subClassOf" in str(p) for p in model["REPLICATE"])
    a, b = placement.Restriction(frozenset("ab"), False), placement.Restriction(frozenset("b"), True)
    assert a.intersect(b).terms == frozenset("a") and a.minus(b).terms == frozenset("b") and a.union(b) == placement.ANY
    assert Equal(Var("x"), Var("y")) == Equal(Var("x"), Var("y"))


def test_placement_by_pragmas():
    rules = programs.MINIMAL_RDFS
    got = placement.advice(rules, placement.schema_pragmas(rules, programs.is_schema), sacrifice=True)
    assert [x for w, x in got if w == "ABANDON"] == ["prp-spo1"] and sum(w == "REPLICATE" for w, _ in got) == 4
    kept = programs.guarded(rules)
    got = placement.advice(kept, placement.schema_pragmas(kept, programs.is_schema), sacrifice=True)
    assert got and not any(w == "ABANDON" for w, _ in got)
    with pytest.raises(placement.NoPlacement):
        placement.Planner(rules).solve(budget=1)
    assert {r.name for r in programs.parallel(programs.OWL_RL)} >= {"prp-dom", "cax-sco", "prp-inv1", "scm-sco"} and not {"prp-trp", "eq-trans", "cls-avf"} & {r.name for r in programs.PARALLEL_OWL}


def test_long_lists_are_walked_to_their_end(spark):
    rdf, n = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", 8
    rows = [(f"_:l{k}", f"<{rdf}first>", f"<a:{k}>") for k in range(n)]
    rows += [(f"_:l{k}", f"<{rdf}rest>", f"_:l{k + 1}" if k + 1 < n else f"<{rdf}nil>") for k in range(n)]
    rows += [("<a:C>", "<http://www.w3.org/2002/07/owl#oneOf>", "_:l0")]
    done = closure(graph(spark, rows), programs.pick(programs.OWL_RL, "cls-oo"), max_iter=3)
    assert done.triples.where(f"p = '<{rdf}type>'").count() == n


def test_retraction_counts_cycles_and_refuses_a_partial_result(spark):
    step = 'If And(?x[<a:{}>->?y]) Then Do(Retract(?x[<a:{}>->?y]) Assert(?x[<a:{}>->?y]))'
    one = graph(spark, [("<a:1>", "<a:p0>", '"v"')])
    done = closure(one, parse("\n".join(step.format(f"p{k}", f"p{k}", f"p{k + 1}") for k in range(3))).rules, max_iter=2)
    assert [tuple(r) for r in done.triples.collect()] == [("<a:1>", "<a:p3>", '"v"')]
    with pytest.raises(NoFixpoint):
        closure(one, parse("\n".join(step.format(a, a, b) for a, b in (("p0", "p1"), ("p1", "p0")))).rules, max_iter=2)


def test_owl_rl_has_reflexive_equality(spark):
    owl = "http://www.w3.org/2002/07/owl#"
    done = closure(graph(spark, [("<a:x>", f"<{owl}differentFrom>", "<a:x>")]), programs.pick(programs.OWL_RL, "eq-ref", "eq-diff1"))
    same = {(r["s"], r["o"]) for r in done.triples.where(f"p = '<{owl}sameAs>'").collect()}
    assert done.inconsistent and {("<a:x>", "<a:x>"), (f"<{owl}differentFrom>",) * 2, (f"<{owl}sameAs>",) * 2} == same

"""Ready programs, written from the rule tables of the W3C RDF Semantics and OWL 2 Profiles.

One rule a line: ``name: head & head <= pattern & pattern``. A pattern is three terms, a
relation ``name(args)``, ``a != b``, ``a in [..]`` or a builtin; ``!`` as a head is an
inconsistency. The tables' ``LIST[?x, ...]`` conditions are the relations ``item``, ``has_all``,
``path`` and ``same_values`` of :mod:`tripleloom.operators.lists`, which no rule derives.
"""

from __future__ import annotations

import re

from .ast import ERROR, Action, And, Atom, Const, Equal, External, Frame, ListTerm, Not, Rule, Var, conjuncts
from .parser import PREFIXES

_WORD = re.compile(r'"[^"]*"(?:\^\^\S+)?|[^\s,]+')


def _term(w: str):
    if w.startswith("?"):
        return Var(w[1:])
    if w.startswith('"'):
        lex, _, dt = w.partition("^^")
        return Const(f"{lex}^^<{_iri(dt)}>" if dt else lex)
    return Const("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>" if w == "a" else f"<{_iri(w)}>")


def _iri(w: str) -> str:
    p, _, rest = w.partition(":")
    return PREFIXES[p] + rest if p in PREFIXES else w.strip("<>")


def _formula(text: str):
    text = text.strip()
    if text == "!":
        return Atom(ERROR, ())
    if m := re.fullmatch(r"(\S+) not in \[(.*)\]", text):
        return Not(External("pred:list-contains", (ListTerm(tuple(map(_term, _WORD.findall(m[2])))), _term(m[1]))))
    if m := re.fullmatch(r"(\S+) in \[(.*)\]", text):
        return External("pred:list-contains", (ListTerm(tuple(map(_term, _WORD.findall(m[2])))), _term(m[1])))
    if m := re.fullmatch(r"(\S+) != (\S+)", text):
        return Not(Equal(_term(m[1]), _term(m[2])))
    if m := re.fullmatch(r"(pred:[\w-]+)\((.*)\)", text):
        return External(m[1], tuple(map(_term, _WORD.findall(m[2]))))
    if m := re.fullmatch(r"(\w+)\((.*)\)", text):
        return Atom(m[1], tuple(map(_term, _WORD.findall(m[2]))))
    s, p, o = map(_term, _WORD.findall(text))
    return Frame(s, ((p, o),))


def rules(text: str) -> list[Rule]:
    out = []
    for line in text.strip().splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, _, rest = line.partition(": ")
        left, _, right = rest.partition(" <= ")
        body = And(tuple(_formula(f) for f in right.split(" & "))) if right else And()
        out.append(Rule(body, tuple(Action("Assert", _formula(f)) for f in left.split(" & ")), name))
    return out


MINIMAL_RDFS = rules("""
scm-spo: ?p rdfs:subPropertyOf ?r <= ?p rdfs:subPropertyOf ?q & ?q rdfs:subPropertyOf ?r
prp-spo1: ?x ?q ?y <= ?p rdfs:subPropertyOf ?q & ?x ?p ?y
prp-dom: ?x a ?c <= ?p rdfs:domain ?c & ?x ?p ?y
prp-rng: ?y a ?c <= ?p rdfs:range ?c & ?x ?p ?y
scm-sco: ?c rdfs:subClassOf ?e <= ?c rdfs:subClassOf ?d & ?d rdfs:subClassOf ?e
cax-sco: ?x a ?d <= ?c rdfs:subClassOf ?d & ?x a ?c
""")

_AXIOMS = "\n".join(
    [f"axiom: {p} a rdf:Property" for p in ("rdf:type", "rdf:subject", "rdf:predicate", "rdf:object", "rdf:first", "rdf:rest", "rdf:value")]
    + ["axiom: rdf:nil a rdf:List"]
    + [f"axiom: {p} rdfs:domain {d} & {p} rdfs:range {r}" for p, d, r in (
        ("rdf:type", "rdfs:Resource", "rdfs:Class"), ("rdfs:domain", "rdf:Property", "rdfs:Class"), ("rdfs:range", "rdf:Property", "rdfs:Class"),
        ("rdfs:subPropertyOf", "rdf:Property", "rdf:Property"), ("rdfs:subClassOf", "rdfs:Class", "rdfs:Class"),
        ("rdf:subject", "rdf:Statement", "rdfs:Resource"), ("rdf:predicate", "rdf:Statement", "rdfs:Resource"), ("rdf:object", "rdf:Statement", "rdfs:Resource"),
        ("rdfs:member", "rdfs:Resource", "rdfs:Resource"), ("rdf:first", "rdf:List", "rdfs:Resource"), ("rdf:rest", "rdf:List", "rdf:List"),
        ("rdfs:seeAlso", "rdfs:Resource", "rdfs:Resource"), ("rdfs:isDefinedBy", "rdfs:Resource", "rdfs:Resource"),
        ("rdfs:comment", "rdfs:Resource", "rdfs:Literal"), ("rdfs:label", "rdfs:Resource", "rdfs:Literal"), ("rdf:value", "rdfs:Resource", "rdfs:Resource"))]
    + [f"axiom: {c} rdfs:subClassOf rdfs:Container" for c in ("rdf:Alt", "rdf:Bag", "rdf:Seq")]
    + ["axiom: rdfs:ContainerMembershipProperty rdfs:subClassOf rdf:Property", "axiom: rdfs:isDefinedBy rdfs:subPropertyOf rdfs:seeAlso", "axiom: rdfs:Datatype rdfs:subClassOf rdfs:Class"]
)

RDFS = MINIMAL_RDFS + rules("""
rdf1: ?p a rdf:Property <= ?x ?p ?y
rdf2: ?y a rdf:XMLLiteral <= ?x ?p ?y & pred:is-literal-XMLLiteral(?y)
rdfs1: ?y a rdfs:Literal <= ?x ?p ?y & pred:is-literal-PlainLiteral(?y)
rdfs4a: ?x a rdfs:Resource <= ?x ?p ?y
rdfs4b: ?y a rdfs:Resource <= ?x ?p ?y
rdfs6: ?p rdfs:subPropertyOf ?p <= ?p a rdf:Property
rdfs8: ?c rdfs:subClassOf rdfs:Resource <= ?c a rdfs:Class
rdfs10: ?c rdfs:subClassOf ?c <= ?c a rdfs:Class
rdfs12: ?p rdfs:subPropertyOf rdfs:member <= ?p a rdfs:ContainerMembershipProperty
rdfs13: ?c rdfs:subClassOf rdfs:Literal <= ?c a rdfs:Datatype
""") + rules(_AXIOMS)

EQUALITY = rules("""
eq-sym: ?y owl:sameAs ?x <= ?x owl:sameAs ?y
eq-trans: ?x owl:sameAs ?z <= ?x owl:sameAs ?y & ?y owl:sameAs ?z
eq-rep-s: ?t ?p ?o <= ?s owl:sameAs ?t & ?s ?p ?o
eq-rep-p: ?s ?q ?o <= ?p owl:sameAs ?q & ?s ?p ?o
eq-rep-o: ?s ?p ?t <= ?o owl:sameAs ?t & ?s ?p ?o
eq-diff1: ! <= ?x owl:sameAs ?y & ?x owl:differentFrom ?y
eq-diff2: ! <= ?d a owl:AllDifferent & ?d owl:members ?l & item(?l, ?x) & item(?l, ?y) & ?x != ?y & ?x owl:sameAs ?y
eq-diff3: ! <= ?d a owl:AllDifferent & ?d owl:distinctMembers ?l & item(?l, ?x) & item(?l, ?y) & ?x != ?y & ?x owl:sameAs ?y
""")
#: Each term the same as itself: eq-ref, eq-ref1 and eq-ref2. Adds a triple for every term.
REFLEXIVE = rules("""
eq-ref: ?s owl:sameAs ?s & ?p owl:sameAs ?p & ?o owl:sameAs ?o <= ?s ?p ?o
""")

PROPERTIES = rules("""
prp-dom: ?x a ?c <= ?p rdfs:domain ?c & ?x ?p ?y
prp-rng: ?y a ?c <= ?p rdfs:range ?c & ?x ?p ?y
prp-fp: ?y owl:sameAs ?z <= ?p a owl:FunctionalProperty & ?x ?p ?y & ?x ?p ?z & ?y != ?z
prp-ifp: ?x owl:sameAs ?z <= ?p a owl:InverseFunctionalProperty & ?x ?p ?y & ?z ?p ?y & ?x != ?z
prp-irp: ! <= ?p a owl:IrreflexiveProperty & ?x ?p ?x
prp-symp: ?y ?p ?x <= ?p a owl:SymmetricProperty & ?x ?p ?y
prp-asyp: ! <= ?p a owl:AsymmetricProperty & ?x ?p ?y & ?y ?p ?x
prp-trp: ?x ?p ?z <= ?p a owl:TransitiveProperty & ?x ?p ?y & ?y ?p ?z
prp-spo1: ?x ?q ?y <= ?p rdfs:subPropertyOf ?q & ?x ?p ?y
prp-spo2: ?x ?p ?y <= ?p owl:propertyChainAxiom ?l & path(?l, ?x, ?y)
prp-eqp1: ?x ?q ?y <= ?p owl:equivalentProperty ?q & ?x ?p ?y
prp-eqp2: ?x ?p ?y <= ?p owl:equivalentProperty ?q & ?x ?q ?y
prp-pdw: ! <= ?p owl:propertyDisjointWith ?q & ?x ?p ?y & ?x ?q ?y
prp-adp: ! <= ?d a owl:AllDisjointProperties & ?d owl:members ?l & item(?l, ?p) & item(?l, ?q) & ?p != ?q & ?x ?p ?y & ?x ?q ?y
prp-inv1: ?y ?q ?x <= ?p owl:inverseOf ?q & ?x ?p ?y
prp-inv2: ?y ?p ?x <= ?p owl:inverseOf ?q & ?x ?q ?y
prp-key: ?x owl:sameAs ?y <= ?c owl:hasKey ?l & same_values(?l, ?x, ?y) & ?x a ?c & ?y a ?c
prp-npa1: ! <= ?n owl:sourceIndividual ?x & ?n owl:assertionProperty ?p & ?n owl:targetIndividual ?y & ?x ?p ?y
prp-npa2: ! <= ?n owl:sourceIndividual ?x & ?n owl:assertionProperty ?p & ?n owl:targetValue ?y & ?x ?p ?y
""")

_ONE = '"1"^^xsd:nonNegativeInteger'
_ZERO = '"0"^^xsd:nonNegativeInteger'
CLASSES = rules(f"""
cls-nothing2: ! <= ?x a owl:Nothing
cls-svf1: ?u a ?x <= ?x owl:someValuesFrom ?y & ?x owl:onProperty ?p & ?u ?p ?v & ?v a ?y
cls-svf2: ?u a ?x <= ?x owl:someValuesFrom owl:Thing & ?x owl:onProperty ?p & ?u ?p ?v
cls-avf: ?v a ?y <= ?x owl:allValuesFrom ?y & ?x owl:onProperty ?p & ?u a ?x & ?u ?p ?v
cls-hv1: ?u ?p ?y <= ?x owl:hasValue ?y & ?x owl:onProperty ?p & ?u a ?x
cls-hv2: ?u a ?x <= ?x owl:hasValue ?y & ?x owl:onProperty ?p & ?u ?p ?y
cls-maxc1: ! <= ?x owl:maxCardinality {_ZERO} & ?x owl:onProperty ?p & ?u a ?x & ?u ?p ?y
cls-maxc2: ?y owl:sameAs ?z <= ?x owl:maxCardinality {_ONE} & ?x owl:onProperty ?p & ?u a ?x & ?u ?p ?y & ?u ?p ?z & ?y != ?z
cls-maxqc1: ! <= ?x owl:maxQualifiedCardinality {_ZERO} & ?x owl:onProperty ?p & ?x owl:onClass ?c & ?u a ?x & ?u ?p ?y & ?y a ?c
cls-maxqc2: ! <= ?x owl:maxQualifiedCardinality {_ZERO} & ?x owl:onProperty ?p & ?x owl:onClass owl:Thing & ?u a ?x & ?u ?p ?y
cls-maxqc3: ?y owl:sameAs ?z <= ?x owl:maxQualifiedCardinality {_ONE} & ?x owl:onProperty ?p & ?x owl:onClass ?c & ?u a ?x & ?u ?p ?y & ?y a ?c & ?u ?p ?z & ?z a ?c & ?y != ?z
cls-maxqc4: ?y owl:sameAs ?z <= ?x owl:maxQualifiedCardinality {_ONE} & ?x owl:onProperty ?p & ?x owl:onClass owl:Thing & ?u a ?x & ?u ?p ?y & ?u ?p ?z & ?y != ?z
cls-com: ! <= ?c owl:complementOf ?d & ?x a ?c & ?x a ?d
cls-int1: ?x a ?c <= ?c owl:intersectionOf ?l & has_all(?l, ?x)
cls-int2: ?x a ?d <= ?c owl:intersectionOf ?l & item(?l, ?d) & ?x a ?c
cls-uni: ?x a ?c <= ?c owl:unionOf ?l & item(?l, ?d) & ?x a ?d
cls-oo: ?x a ?c <= ?c owl:oneOf ?l & item(?l, ?x)
cax-sco: ?x a ?d <= ?c rdfs:subClassOf ?d & ?x a ?c
cax-eqc1: ?x a ?d <= ?c owl:equivalentClass ?d & ?x a ?c
cax-eqc2: ?x a ?c <= ?c owl:equivalentClass ?d & ?x a ?d
cax-dw: ! <= ?c owl:disjointWith ?d & ?x a ?c & ?x a ?d
cax-adc: ! <= ?a a owl:AllDisjointClasses & ?a owl:members ?l & item(?l, ?c) & item(?l, ?d) & ?c != ?d & ?x a ?c & ?x a ?d
""")

SCHEMA = rules("""
scm-cls: ?c rdfs:subClassOf ?c & ?c owl:equivalentClass ?c & ?c rdfs:subClassOf owl:Thing & owl:Nothing rdfs:subClassOf ?c <= ?c a owl:Class
scm-sco: ?c rdfs:subClassOf ?e <= ?c rdfs:subClassOf ?d & ?d rdfs:subClassOf ?e
scm-eqc1: ?c rdfs:subClassOf ?d & ?d rdfs:subClassOf ?c <= ?c owl:equivalentClass ?d
scm-eqc2: ?c owl:equivalentClass ?d <= ?c rdfs:subClassOf ?d & ?d rdfs:subClassOf ?c
scm-op: ?p rdfs:subPropertyOf ?p & ?p owl:equivalentProperty ?p <= ?p a owl:ObjectProperty
scm-dp: ?p rdfs:subPropertyOf ?p & ?p owl:equivalentProperty ?p <= ?p a owl:DatatypeProperty
scm-spo: ?p rdfs:subPropertyOf ?r <= ?p rdfs:subPropertyOf ?q & ?q rdfs:subPropertyOf ?r
scm-eqp1: ?p rdfs:subPropertyOf ?q & ?q rdfs:subPropertyOf ?p <= ?p owl:equivalentProperty ?q
scm-eqp2: ?p owl:equivalentProperty ?q <= ?p rdfs:subPropertyOf ?q & ?q rdfs:subPropertyOf ?p
scm-dom1: ?p rdfs:domain ?d <= ?p rdfs:domain ?c & ?c rdfs:subClassOf ?d
scm-dom2: ?p rdfs:domain ?c <= ?q rdfs:domain ?c & ?p rdfs:subPropertyOf ?q
scm-rng1: ?p rdfs:range ?d <= ?p rdfs:range ?c & ?c rdfs:subClassOf ?d
scm-rng2: ?p rdfs:range ?c <= ?q rdfs:range ?c & ?p rdfs:subPropertyOf ?q
scm-hv: ?c rdfs:subClassOf ?d <= ?c owl:hasValue ?i & ?c owl:onProperty ?p & ?d owl:hasValue ?i & ?d owl:onProperty ?q & ?p rdfs:subPropertyOf ?q
scm-svf1: ?c rdfs:subClassOf ?d <= ?c owl:someValuesFrom ?y & ?c owl:onProperty ?p & ?d owl:someValuesFrom ?z & ?d owl:onProperty ?p & ?y rdfs:subClassOf ?z
scm-svf2: ?c rdfs:subClassOf ?d <= ?c owl:someValuesFrom ?y & ?c owl:onProperty ?p & ?d owl:someValuesFrom ?y & ?d owl:onProperty ?q & ?p rdfs:subPropertyOf ?q
scm-avf1: ?c rdfs:subClassOf ?d <= ?c owl:allValuesFrom ?y & ?c owl:onProperty ?p & ?d owl:allValuesFrom ?z & ?d owl:onProperty ?p & ?y rdfs:subClassOf ?z
scm-avf2: ?d rdfs:subClassOf ?c <= ?c owl:allValuesFrom ?y & ?c owl:onProperty ?p & ?d owl:allValuesFrom ?y & ?d owl:onProperty ?q & ?p rdfs:subPropertyOf ?q
scm-int: ?c rdfs:subClassOf ?d <= ?c owl:intersectionOf ?l & item(?l, ?d)
scm-uni: ?d rdfs:subClassOf ?c <= ?c owl:unionOf ?l & item(?l, ?d)
""")

OWL_AXIOMS = rules("\n".join(
    [f"prp-ap: {p} a owl:AnnotationProperty" for p in ("rdfs:label", "rdfs:comment", "rdfs:seeAlso", "rdfs:isDefinedBy", "owl:versionInfo", "owl:priorVersion", "owl:backwardCompatibleWith", "owl:incompatibleWith", "owl:deprecated")]
    + ["cls-thing: owl:Thing a owl:Class", "cls-nothing1: owl:Nothing a owl:Class"]
))

OWL_RL = EQUALITY + REFLEXIVE + PROPERTIES + CLASSES + SCHEMA + OWL_AXIOMS


def pick(program: list[Rule], *names: str) -> list[Rule]:
    """Rules of a program by name."""
    found = [r for r in program if r.name in names]
    if missing := set(names) - {r.name for r in found}:
        raise KeyError(sorted(missing))
    return found


# --- variants --------------------------------------------------------------------------------

#: Predicates and classes of schema triples, which are few and can be everywhere.
SCHEMA_PREDICATES = tuple(_term(w).term for w in """rdfs:domain rdfs:range rdfs:subPropertyOf rdfs:subClassOf owl:equivalentClass owl:equivalentProperty owl:inverseOf owl:propertyDisjointWith
owl:disjointWith owl:complementOf owl:intersectionOf owl:unionOf owl:oneOf owl:propertyChainAxiom owl:hasKey owl:members owl:distinctMembers owl:onProperty owl:onClass owl:hasValue
owl:someValuesFrom owl:allValuesFrom owl:maxCardinality owl:maxQualifiedCardinality rdf:first rdf:rest""".split())
SCHEMA_CLASSES = tuple(_term(w).term for w in """rdfs:Class rdfs:Datatype rdfs:ContainerMembershipProperty rdf:Property owl:Class owl:ObjectProperty owl:DatatypeProperty owl:FunctionalProperty
owl:InverseFunctionalProperty owl:SymmetricProperty owl:AsymmetricProperty owl:TransitiveProperty owl:IrreflexiveProperty owl:AllDifferent owl:AllDisjointProperties owl:AllDisjointClasses""".split())
_TYPE = _term("a").term


def is_schema(pattern) -> bool:
    """Whether a one-slot frame, or a relation over lists, is about the schema alone."""
    if isinstance(pattern, Atom):
        return pattern.name == "item"
    pred, obj = pattern.slots[0]
    return isinstance(pred, Const) and (pred.term in SCHEMA_PREDICATES or (pred.term == _TYPE and isinstance(obj, Const) and obj.term in SCHEMA_CLASSES))


def parallel(program: list[Rule]) -> list[Rule]:
    """Rules with at most one pattern over instances: with the schema everywhere, parts of the data can be closed alone."""
    out = []
    for r in program:
        found = [Frame(p.subject, (s,)) for p in conjuncts(r.body) if isinstance(p, Frame) for s in p.slots] + [p for p in conjuncts(r.body) if isinstance(p, Atom)]
        if sum(not is_schema(p) for p in found) <= 1:
            out.append(r)
    return out


def guarded(program: list[Rule]) -> list[Rule]:
    """Rules that read instances kept from making schema triples: their classes and predicates must not be of the schema."""
    out = []
    for r in program:
        reads = [Frame(p.subject, (s,)) for p in conjuncts(r.body) if isinstance(p, Frame) for s in p.slots]
        extra: dict = {}
        if not all(map(is_schema, reads)):
            for a in r.actions:
                if isinstance(a.target, Frame):
                    for pred, obj in a.target.slots:
                        if isinstance(pred, Var):
                            extra[pred] = SCHEMA_PREDICATES
                        elif pred.term == _TYPE and isinstance(obj, Var):
                            extra[obj] = SCHEMA_CLASSES
        more = tuple(Not(External("pred:list-contains", (ListTerm(tuple(map(Const, names))), v))) for v, names in extra.items())
        out.append(Rule(And((*conjuncts(r.body), *more)), r.actions, r.name) if more else r)
    return out


#: Equality alone: symmetric, transitive, replacing.
SAME_AS = [r for r in EQUALITY if r.name in ("eq-sym", "eq-trans", "eq-rep-s", "eq-rep-p", "eq-rep-o")]
PRACTICAL_RDFS = guarded(parallel(RDFS))
PARALLEL_OWL = parallel(OWL_RL)
PARALLEL_MINIMAL_OWL = guarded(parallel([r for r in OWL_RL if r not in REFLEXIVE]))

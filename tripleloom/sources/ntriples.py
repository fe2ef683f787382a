"""N-Triples in and out. A line that is no triple goes to a side channel; it never fails the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import iri as iris, lang as tags, terms

_TERM = r'<[^<>\s]*>|_:\S+|\[\]|"(?:[^"\\]|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?'
_SCHEME = "^<[A-Za-z][A-Za-z0-9+.-]*:"
#: A numeric escape of a surrogate or beyond the last code point, after an even number of backslashes.
_BAD_POINT = r"(?<!\\)(?:\\\\)*\\(?:u[Dd][89A-Fa-f][0-9A-Fa-f]{2}|U(?!000|0010)[0-9A-Fa-f]{8}|U0000[Dd][89A-Fa-f][0-9A-Fa-f]{2}|U00[2-9A-Fa-f][0-9A-Fa-f]{5}|U001[1-9A-Fa-f][0-9A-Fa-f]{4})"
_LINE = rf"^\s*(\S+)\s+(\S+)\s+({_TERM})\s*(?:\.\s*)?$"


def _is_iri(x: Column) -> Column:
    return iris.is_iri(canonical(x))


def parse(line: Column) -> Column:
    """Struct s, p, o, error of a line; error is null for a triple. The line and each of its terms are worked out once."""
    return terms.let(line, lambda l: terms.let(F.struct(*[F.regexp_extract(l, _LINE, k).alias(c) for k, c in enumerate("spo", 1)]), lambda t: terms.let(_error(l, t), lambda e: _parsed(t, e))))


def _parsed(t: Column, error: Column) -> Column:
    return F.struct(*[F.when(error.isNull(), canonical(t[c])).alias(c) for c in "spo"], error.alias("error"))


def _error(line: Column, t: Column) -> Column:
    s, p, o = t["s"], t["p"], t["o"]
    iri = r"<([A-Za-z][A-Za-z0-9+.-]*:[^<>\s]*)>$"
    wrong = lambda x: x.startswith("<") & ~_is_iri(F.regexp_extract(x, "^" + iri, 1))
    kind = F.regexp_extract(o, r"\^\^" + iri, 1)
    tag = F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)
    return (
        F.when(~F.is_valid_utf8(line), "invalid UTF-8")
        .when(line.rlike(_BAD_POINT), "invalid code point")
        .when(~line.rlike(_LINE), "not a triple")
        .when(s.startswith('"'), "literal subject")
        .when(~s.rlike(rf"^(?:{_TERM})$"), "invalid subject")
        .when(~p.rlike(r"^<[^<>\s]*>$"), "predicate is no IRI")
        .when(~p.rlike(_SCHEME) | s.rlike("^<") & ~s.rlike(_SCHEME) | o.rlike("^<") & ~o.rlike(_SCHEME), "relative IRI")
        .when(wrong(s) | wrong(p) | wrong(o) | (o.rlike(r'"\^\^<[^>]*>$') & ~_is_iri(kind)), "malformed IRI")
        .when((tag != "") & ~tags.is_valid(tag), "malformed language tag")
    )


def canonical(t: Column) -> Column:
    """A term with numeric escapes undone."""
    numeric = t.rlike(r"\\[uU]")
    lit = F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*+)"', 1)
    tail = F.substring(t, F.length(lit) + 3, 1 << 30)
    return F.when(~numeric, t).when(t.startswith('"'), F.concat(F.lit('"'), terms.escape(terms.unescape(lit)), F.lit('"'), tail)).otherwise(terms.unescape(t))


def read(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(triples s, p, o; errors line, error) of line-split files. Blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.explode(F.array(parse(F.col("value")))).alias("t"))  # a filter is not moved before it, which would parse twice
    good = parsed.where("t.error is null").select("t.s", "t.p", "t.o")
    return good, parsed.where("t.error is not null").select(F.col("value").alias("line"), "t.error")


def serialize(s: Column, p: Column, o: Column) -> Column:
    """One line: blank labels made alphanumeric, characters beyond ASCII escaped, ``>`` in IRIs as ``%3E``.

    An anonymous node is another one wherever it stands; it gets a label of its own, which starts with ``Q`` (other labels do not).
    """

    def shown(t):
        return terms.let(t, known)

    def known(t):
        label = F.concat(F.lit("_:"), terms.sanitize_label(F.substring(t, 3, 1 << 30)))
        iri = F.concat(F.lit("<"), F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit(">"), F.lit("%3E")), F.lit(">"))
        fresh = F.concat(F.lit("_:Q"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))
        return terms.escape_unicode(F.when(t == "[]", fresh).when(t.startswith("_:"), label).when(t.startswith("<"), iri).otherwise(t))

    return F.concat_ws(" ", shown(s), shown(p), shown(o), F.lit("."))


def write(triples: DataFrame, path: str, compression: str | None = None) -> None:
    """Triples that RDF allows, as text part files, compressed by any codec of Spark's."""
    valid = triples.where(~F.col("s").startswith('"') & F.col("p").startswith("<"))
    out = valid.select(serialize(F.col("s"), F.col("p"), F.col("o")).alias("value")).write
    (out.option("compression", compression) if compression else out).text(path)

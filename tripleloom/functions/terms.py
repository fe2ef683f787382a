"""RDF terms as Column expressions.

A term is held in its canonical N-Triples form, one string; :func:`as_struct` splits it.
Equality is lexical. Everything here runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BNODE, IRI, SIMPLE, LANG, TYPED = 1, 2, 3, 4, 5
#: Names of the kinds.
KIND_NAMES = {BNODE: "bnode", IRI: "iri", SIMPLE: "simple", LANG: "lang", TYPED: "typed"}
_LITERAL = r'^"((?:[^"\\]|\\.)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'


def let(x: Column, f) -> Column:
    """``f`` of ``x``, which is worked out once however often ``f`` names it (a column of an expression is copied at each name)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def kind(t: Column) -> Column:
    """1 blank node, 2 IRI, 3 simple, 4 language-tagged, 5 typed literal; null if it is no term."""
    return (
        F.when(t.startswith("_:") | (t == "[]"), BNODE)
        .when(t.rlike("^<[^<>\\s]*>$"), IRI)
        .when(t.rlike(r'^"(?:[^"\\]|\\.)*+"$'), SIMPLE)
        .when(t.rlike(r'^"(?:[^"\\]|\\.)*+"@[A-Za-z0-9-]+$'), LANG)
        .when(t.rlike(r'^"(?:[^"\\]|\\.)*+"\^\^<[^>]*>$'), TYPED)
    )


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def is_plain_literal(t: Column) -> Column:
    return kind(t).isin(SIMPLE, LANG)


def is_anonymous(t: Column) -> Column:
    return t == "[]"


def label(t: Column) -> Column:
    return F.when(t.startswith("_:"), F.substring(t, 3, 1 << 30))


def iri(t: Column) -> Column:
    return F.when(kind(t) == IRI, F.regexp_extract(t, "^<(.*)>$", 1))


def lexical(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, _LITERAL, 1))


def language(t: Column) -> Column:
    return F.when(kind(t) == LANG, F.regexp_extract(t, _LITERAL, 2))


def datatype(t: Column) -> Column:
    return F.when(kind(t) == TYPED, F.regexp_extract(t, _LITERAL, 3))


def as_struct(t: Column) -> Column:
    """kind, lex, lang, dt of a canonical term (lex holds the label or the IRI too)."""
    lex = F.coalesce(iri(t), label(t), unescape(lexical(t)))
    return F.struct(kind(t).cast("tinyint").alias("kind"), lex.alias("lex"), language(t).alias("lang"), datatype(t).alias("dt"))


def from_struct(c: Column) -> Column:
    """Canonical term of a struct made by :func:`as_struct`."""
    quoted = F.concat(F.lit('"'), escape(c["lex"]), F.lit('"'))
    return (
        F.when(c["kind"] == BNODE, F.concat(F.lit("_:"), c["lex"]))
        .when(c["kind"] == IRI, F.concat(F.lit("<"), c["lex"], F.lit(">")))
        .when(c["kind"] == SIMPLE, quoted)
        .when(c["kind"] == LANG, F.concat(quoted, F.lit("@"), c["lang"]))
        .when(c["kind"] == TYPED, F.concat(quoted, F.lit("^^<"), c["dt"], F.lit(">")))
    )


def escape(s: Column) -> Column:
    """Backslash escapes of tab, newline, carriage return, quote and backslash."""
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        s = F.replace(s, F.lit(raw), F.lit(shown))
    return s


def _from_hex(h: Column) -> Column:
    """The character of a code point in hexadecimal (surrogates and beyond the range give U+FFFD)."""
    code = F.conv(h, 16, 10).cast("long")
    utf32 = F.lpad(F.hex(code), 8, "0")
    bad = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(bad, F.lit("�")).otherwise(F.decode(F.unhex(utf32), "UTF-32"))


def unescape(s: Column) -> Column:
    """Undo :func:`escape` and numeric escapes, in one walk along the escapes."""
    pattern = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)"
    marks = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    gaps = F.split(s, pattern, -1)

    def plain(m):
        c = F.substring(m, 2, 1)
        return (
            F.when(c.isin("u", "U") & (F.length(m) > 2), _from_hex(F.substring(m, 3, 8)))
            .when(c == "t", F.lit("\t"))
            .when(c == "n", F.lit("\n"))
            .when(c == "r", F.lit("\r"))
            .otherwise(c)
        )

    joined = F.concat(
        F.array_join(F.zip_with(F.slice(gaps, 1, F.size(marks)), marks, lambda g, m: F.concat(g, plain(m))), ""),
        F.element_at(gaps, -1),
    )
    return F.when(F.contains(s, F.lit("\\")), joined).otherwise(s)


def escape_unicode(s: Column) -> Column:
    """Every character beyond ASCII as ``\\uXXXX`` or ``\\UXXXXXXXX`` in upper case."""
    return let(s, _escape_unicode)


def _escape_unicode(s: Column) -> Column:
    def shown(c):
        code = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        return F.when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(F.hex(code), 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(F.hex(code), 8, "0")))

    odd = F.regexp_extract_all(s, F.lit(r"[^\x00-\x7F]"), F.lit(0))
    gaps = F.split(s, r"[^\x00-\x7F]", -1)
    joined = F.concat(
        F.array_join(F.zip_with(F.slice(gaps, 1, F.size(odd)), odd, lambda g, m: F.concat(g, shown(m))), ""),
        F.element_at(gaps, -1),
    )
    return F.when(s.rlike(r"[^\x00-\x7F]"), joined).otherwise(s)


def sanitize_label(x: Column) -> Column:
    """Blank node label in ASCII letters and digits.

    Alphanumeric labels that start with Q, X, Z or a digit get ``X`` before them; others
    become ``Z``, the part before the first other byte, and from there on every other byte
    and every ``Z`` as ``Zhh``.
    """
    head = F.regexp_extract(x, "^([A-Za-z0-9]*)", 1)
    rest = F.hex(F.encode(F.substring(x, F.length(head) + 1, F.lit(1 << 30)), "UTF-8"))
    pairs = F.regexp_extract_all(rest, F.lit("(..)"), F.lit(1))

    def shown(h):
        c = F.decode(F.unhex(h), "ISO-8859-1")
        return F.when(c.rlike("^[A-Ya-z0-9]$"), c).otherwise(F.concat(F.lit("Z"), h))

    odd = F.concat(F.lit("Z"), head, F.array_join(F.transform(pairs, shown), ""))
    return F.when(x.rlike("^[A-Za-z0-9]+$"), F.when(x.rlike("^[QXZ0-9]"), F.concat(F.lit("X"), x)).otherwise(x)).otherwise(odd)


def is_ncname(x: Column) -> Column:
    """Whether ``x`` is a name without a colon: a letter or underscore, then letters, digits, marks, ``.``, ``-``, ``_``."""
    return x.rlike(r"^[\p{L}_][\p{L}\p{M}\p{N}._\x{B7}-]*$")


def ground(t: Column, base: str = "tag:tripleloom,2024:blank#") -> Column:
    """Blank nodes as IRIs, for comparisons."""
    return F.regexp_replace(t, r"^_:(.+)$", f"<{base}$1>")


def sort_key(t: Column) -> Column:
    """Total order of terms: anonymous, labelled by bytes, IRIs by bytes, simple, tagged by (tag, form), typed by (type, form)."""
    k = F.when(is_anonymous(t), 0).otherwise(kind(t))
    first = F.coalesce(F.lower(language(t)), datatype(t), F.lit(""))
    return F.struct(k.alias("k"), first.alias("a"), F.coalesce(lexical(t), iri(t), label(t), F.lit("")).alias("b"))


def one_at_a_time(s: Column) -> Column:
    """Jenkins' one-at-a-time hash of the UTF-8 bytes, as an unsigned 32-bit number."""
    mask = F.lit(0xFFFFFFFF)
    low = lambda x: x.bitwiseAND(mask)

    def step(h, b):
        h = low(h + F.conv(b, 16, 10).cast("long"))
        h = low(h + low(F.shiftleft(h, 10)))
        return h.bitwiseXOR(F.shiftright(h, 6))

    def end(h):
        h = low(h + low(F.shiftleft(h, 3)))
        h = h.bitwiseXOR(F.shiftright(h, 11))
        return low(h + low(F.shiftleft(h, 15)))

    return F.aggregate(F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("(..)"), F.lit(1)), F.lit(0).cast("long"), step, end)


def compact(t: Column, prefixes: dict[str, str]) -> Column:
    """CURIE of an IRI by the first prefix that fits; other terms unchanged."""
    out = t
    for p, base in reversed(list(prefixes.items())):
        out = F.when(t.startswith("<" + base), F.concat(F.lit(p + ":"), F.regexp_replace(F.substring(t, len(base) + 2, 1 << 30), ">$", ""))).otherwise(out)
    return out


def expand(t: Column, prefixes: dict[str, str]) -> Column:
    """Canonical IRI of a CURIE; other terms unchanged."""
    out = t
    for p, base in reversed(list(prefixes.items())):
        out = F.when(t.startswith(p + ":"), F.concat(F.lit("<" + base), F.substring(t, len(p) + 2, 1 << 30), F.lit(">"))).otherwise(out)
    return out

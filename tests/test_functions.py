"""Scalar functions, from the texts of the standards."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tripleloom.functions import iri, lang, terms, unicode as uni
from tripleloom.sources import convert, dictionary, ntriples


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_terms(spark):
    ts = ["<http://e/a>", "_:b", '"x"', '"x\\"y"@en-GB', '"1"^^<http://t>', "junk", "[]"]
    assert one(spark, terms.kind, *ts) == [2, 1, 3, 4, 5, None, 1]
    assert one(spark, terms.language, *ts)[3] == "en-GB"
    assert one(spark, terms.datatype, *ts)[4] == "http://t"
    assert one(spark, lambda x: terms.from_struct(terms.as_struct(x)), *ts[:5]) == ts[:5]
    assert one(spark, terms.unescape, 'a\\tb\\\\n\\u00e9\\U0001F600\\"', "plain", "") == ['a\tb\\né😀"', "plain", ""]
    assert one(spark, terms.escape_unicode, "aé😀", "") == ["a\\u00E9\\U0001F600", ""]
    assert one(spark, terms.sanitize_label, "abc", "Qx", "9", "a_bZ") == ["abc", "XQx", "X9", "ZaZ5FbZ5A"]
    assert one(spark, terms.ground, "_:x", "<a>")[1] == "<a>"


def jenkins(b: bytes) -> int:
    h = 0
    for c in b:
        h = (h + c) & 0xFFFFFFFF
        h = (h + (h << 10)) & 0xFFFFFFFF
        h ^= h >> 6
    h = (h + (h << 3)) & 0xFFFFFFFF
    h ^= h >> 11
    return (h + (h << 15)) & 0xFFFFFFFF


def test_hash(spark):
    words = ["", "a", "hello é"]
    assert one(spark, terms.one_at_a_time, *words) == [jenkins(w.encode()) for w in words]


def test_iri_split(spark):
    x = "http://u:p@Example.org:80/a/b?q=1#f"
    for part, want in zip(iri.PARTS, ("http", "u:p", "Example.org", "80", "/a/b", "q=1", "f")):
        assert one(spark, lambda c, p=part: iri.part(c, p), x) == [want]
    assert one(spark, lambda c: iri.part(c, "query"), "http://e/a", "http://e/a?") == [None, ""]
    assert one(spark, iri.is_relative, "a/b", "http://e") == [True, False]
    assert one(spark, iri.urify, "http://e/é") == ["http://e/%C3%A9"]


@pytest.mark.parametrize(
    "ref, want",
    [("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("g;x=1/../y", "http://a/b/c/y"), ("g:h", "g:h")],
)
def test_resolve(ref, want):
    assert iri.resolve_text(ref, "http://a/b/c/d;p?q") == want


def test_iri_normalize():
    assert iri.normalize_text("HTTP://EXAMPLE.org/%7ea/../b%2f") == "http://example.org/b%2F"
    assert iri.normalize_text("http://e/%C3%A9") == "http://e/é"


def test_lang(spark):
    valid = ["de", "de-Latn-DE", "sl-rozaj-biske", "en-a-bbb-x-a", "x-any", "i-klingon", "zh-yue-HK"]
    assert one(spark, lang.is_valid, *valid, "d", "de-", "en-a") == [True] * 7 + [False] * 3
    assert one(spark, lambda c: lang.part(c, "region"), "de-Latn-de", "de") == ["de", None]
    assert one(spark, lang.normalize, "DE-latn-de", "iw", "I-KLINGON") == ["de-Latn-DE", "he", "tlh"]
    assert one(spark, lang.extlangify, "yue-HK", "de") == ["zh-yue-HK", "de"]
    assert one(spark, lambda c: lang.matches_basic(c, "de-DE"), "de-de", "de-DE-x", "de-Latn-DE", "deu") == [True, True, False, False]
    assert one(spark, lambda c: lang.matches_extended(c, "de-DE"), "de-Latn-DE", "de-DE-x-a", "de-x-DE", "de-AT") == [True, True, False, False]


def test_unicode(spark):
    x = "é Å ﬁ ascii"
    for form in uni.FORMS:
        assert one(spark, lambda c, f=form: uni.normalize(c, f), x, "abc", None) == [unicodedata.normalize(form, x), "abc", None]


def test_ntriples(spark, tmp_path):
    lines = ['<http://e/a> <http://e/p> "caf\\u00E9"@fr .', "", "broken", '"l" <http://e/p> <http://e/a> .', "_:x <http://e/p> _:y"]
    (tmp_path / "in.nt").write_text("\n".join(lines) + "\n")
    good, bad = ntriples.read(spark, str(tmp_path / "in.nt"))
    assert {tuple(r) for r in good.collect()} == {("<http://e/a>", "<http://e/p>", '"café"@fr'), ("_:x", "<http://e/p>", "_:y")}
    assert sorted(r["error"] for r in bad.collect()) == ["literal subject", "not a triple"]
    convert.write(good, str(tmp_path / "enc"), "encoded")
    convert.convert(spark, str(tmp_path / "enc"), "encoded", str(tmp_path / "out"), "nt", compression="gzip")
    back, _ = ntriples.read(spark, str(tmp_path / "out"))
    assert back.exceptAll(good).count() == 0 and back.count() == 2


def test_dictionary(spark, tmp_path):
    g = spark.createDataFrame([("<a>", "<p>", "<b>"), ("<b>", "<p>", '"x"')], "s string, p string, o string")
    ids, d = dictionary.encode(g)
    rows = {r["term"]: r["id"] for r in d.collect()}
    assert [rows[t] for t in sorted(rows)] == [1, 2, 3, 4]
    assert dictionary.decode(ids, d).exceptAll(g).count() == 0
    raw = ids.select(dictionary.der_record("s", "p", "o").alias("b")).collect()
    (tmp_path / "x.der").write_bytes(b"".join(bytes(r["b"]) for r in raw) + bytes.fromhex("8" + "0" * 14 + "1") * 3)
    got = {tuple(r) for r in dictionary.read_der(spark, str(tmp_path / "x.der")).collect()}
    assert {tuple(r) for r in ids.collect()} | {(-(2**63) + 1,) * 3} == got
    recs = d.select(dictionary.dictionary_record("id", "term").alias("b")).collect()
    (tmp_path / "x.dct").write_bytes(b"".join(bytes(r["b"]) for r in recs))
    assert {r["term"]: r["id"] for r in dictionary.read_dictionary(spark, str(tmp_path / "x.dct")).collect()} == rows


def test_anonymous_nodes_get_labels(spark):
    df = spark.createDataFrame([("[]", "<a:p>", "[]"), ("_:Qx", "<a:p>", "[]")], "s string, p string, o string")
    lines = [r[0] for r in df.select(ntriples.serialize(F.col("s"), F.col("p"), F.col("o"))).collect()]
    labels = [w for x in lines for w in x.split() if w.startswith("_:Q")]
    assert len(labels) == len(set(labels)) == 3 and "_:XQx" in lines[1]


def test_byte_orders(spark):
    df = spark.createDataFrame([(bytearray("a\U0001F600\u00e9".encode(e)), e) for e in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be")], "b binary, e string")
    for r in df.select("e", *[uni.is_valid(F.col("b"), n).alias(n) for n in ("UTF-16LE", "UTF-16BE", "UTF-32LE", "UTF-32BE")]).collect():
        assert r[r["e"].upper().replace("-LE", "LE").replace("-BE", "BE")]
    bad = spark.createDataFrame([(bytearray(x),) for x in (b"\x00\xd8", b"\x00\xd8a\x00", b"\x00\xdc")], "b binary")
    assert not any(r[0] for r in bad.select(uni.is_valid(F.col("b"), "UTF-16LE")).collect())
    assert bad.select(uni.mark(F.lit(bytearray(b"\xff\xfea\x00"))).alias("m")).first()["m"] == "UTF-16LE"

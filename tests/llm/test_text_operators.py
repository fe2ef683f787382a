"""Encoding, packing and the classifiers, against the libraries and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tripleloom.llm.langid import LangId
from tripleloom.llm.packing import Tournament, first_fit_decreasing, pack_documents, token_pieces, word_ids
from tripleloom.llm.pieces import Pieces, encode_documents
from tripleloom.llm.quality import Quality
from tripleloom.llm.toxicity import Toxicity

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "Hello, wörld! It's 1234.", "İstanbul ǅ ſ Σας ½ x'.", "<|endoftext|> <s> </s> ▁", "a" * 3000, "ab" * 900 + "\n\t\x0b x\x1cy\xa0z", "漢字 😀 é ​", "the the the", "the the the"]


def docs(spark, texts=TEXTS):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 7, 1.0, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, length long, score double, __other string")


def test_pieces_equal_the_library():
    import sentencepiece

    sp, own, rnd = sentencepiece.SentencePieceProcessor(model_file=MODEL), Pieces(MODEL), random.Random(3)
    some = [t or "" for t in TEXTS] + ["".join(rnd.choice("aabcde  \t▁ñé漢😀01.") for _ in range(rnd.randint(0, 50))) for _ in range(400)]
    for t in some:
        ids = sp.encode(t, add_eos=True)
        assert own.encode(t) == ids
        assert own.decode(ids) == sp.decode(ids)


def test_encode_documents(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r for r in encode_documents(docs(spark), MODEL, with_ids=True).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "", add_eos=True)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == sp.decode(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert encode_documents(docs(spark, []), MODEL).count() == 0


def test_tournament_is_first_fit():
    rnd = random.Random(1)
    sizes = sorted((rnd.randint(1, 100) for _ in range(300)), reverse=True)
    bins, offsets = first_fit_decreasing(sizes, 100)
    room: list[int] = []
    for s, b, o in zip(sizes, bins, offsets):
        want = next((k for k, r in enumerate(room) if r >= s), len(room))
        if want == len(room):
            room.append(100)
        assert (want, 100 - room[want]) == (b, o)
        room[want] -= s
    with pytest.raises(ValueError):
        Tournament(1, 5).place(6)


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rows = pack_documents(docs(spark), WORDS, length=64, group=50).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(TEXTS)}
    for i, want in ids.items():
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        at = 0
        for s, n, crc in mine:
            assert s == at and crc == zlib.crc32(np.array(want[s : s + n], "<u4").tobytes())
            at += n
        assert at == len(want)
    for seq in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == seq), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert pack_documents(docs(spark, []), WORDS).count() == 0
    again = token_pieces(docs(spark, ["x y"]), WORDS, with_ids=True).collect()
    assert again[0]["ids"] == tok.encode("x y", add_special_tokens=False).ids + [1]


def test_plain_words_take_the_short_way_safely():
    w = word_ids(WORDS)
    for c in range(0xC0, 0x250):
        t = "a" + chr(c) + "b."
        assert w.word(t) == np.array(w.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def corpus(n=240):
    rnd = random.Random(5)
    kinds = {"en": "the of and ing tion er".split(), "de": "der und sch keit ung ein".split(), "fr": "le de eau oir ment que".split()}
    out = []
    for i in range(n):
        lang = rnd.choice(sorted(kinds))
        out.append((i, " ".join("".join(rnd.choice(kinds[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(3, 40))), lang))
    return out


def test_language_id(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + [(1000, None, "de"), (1001, "123 !", "fr"), (1002, "der", None)], "doc_id long, text string, lang string")
    model = LangId().fit(df.where("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r for r in model.transform(df).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    none = LangId().fit(df.where("false")).transform(df)
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_toxicity_learns_words_and_their_misspellings():
    rnd, base = random.Random(2), [t for _, t, _ in corpus(500)]
    bad, texts, labels = ["idiot", "worthless", "disgusting"], [], []
    for t in base:
        ws, y = t.split(), rnd.random() < 0.4
        if y:
            ws.insert(rnd.randrange(len(ws) + 1), rnd.choice(bad))
        texts.append(" ".join(ws))
        labels.append(int(y))
    model = Toxicity().fit_rows(texts[:400], labels[:400])
    s, y = model.scorer()(texts[400:]), np.array(labels[400:])
    assert ((s >= 0.5) == y).mean() > 0.95
    clean, odd, empty = model.scorer()(["the of and der und", "you worthles er", ""])
    assert odd > clean and 0 <= empty <= 1
    assert Toxicity().fit_rows([], []).scorer()(["x"])[0] < 0.5


def test_quality_learns_structure():
    base = [t for _, t, _ in corpus(300)]
    texts = [" ".join(w + "###" for w in t.split()) if i % 3 == 0 else " | ".join(t.split()) if i % 3 == 1 and i % 2 else t for i, t in enumerate(base)]
    labels = [int(a == b) for a, b in zip(texts, base)]
    model = Quality().fit_rows(texts[:200], labels[:200])
    s, y = model.scorer()(texts[200:]), np.array(labels[200:])
    assert ((s >= 0.3) == y).mean() > 0.95
    assert model.scorer()(["", None, "a " * 20000]).shape == (3,)
    assert Quality().fit_rows(["a"], [1]).scorer()(["b"])[0] > 0.9


def test_classifiers_over_frames(spark):
    df = spark.createDataFrame([(i, None if i == 5 else t, i) for i, (_, t, _) in enumerate(corpus(60))], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, i % 2, None if i % 7 == 0 else (i + 1) % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for model in (Quality().fit(df, labels), Toxicity().fit(df, labels)):
        out = model.transform(df)
        assert out.count() == 60 and out.where(F.col("score").between(0, 1)).count() == 60
    assert Quality().fit(df.where("false"), labels).transform(df).count() == 60


@pytest.mark.parametrize("model", [Toxicity, Quality])
def test_capped_sample_keeps_the_class_shares(spark, model):
    df = spark.createDataFrame([(i, "the same words for all") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id long, y int")
    whole, cut = (model().fit(df, labels, label="y", per_class=n).scorer()(["the same words for all"])[0] for n in (1000, 20))
    assert abs(whole - 0.1) < 0.05 and abs(cut - 0.1) < 0.05

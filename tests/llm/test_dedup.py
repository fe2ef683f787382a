"""Near duplicates and repeated substrings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tripleloom.llm import minhash, suffix
from tripleloom.llm.minhash import CHUNKS, DISTANCE, SIZE, bucket_keys, close, distances, near_duplicate_rows, near_duplicates, signature, unpack
from tripleloom.llm.suffix import remove_repeats, suffix_array


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(texts, num):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], sets


def some_texts():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    texts = [None, "", "  ", "one two", "One  TWO", "a b c d e"]
    for _ in range(6):
        base = [word() for _ in range(rnd.randint(30, 120))]
        texts += [" ".join(base)] * 2
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randint(1, 4)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("num", [80, 85])
def test_near_duplicates_equal_brute_force(spark, num):
    texts = some_texts()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n long, key string")
    got = {r["doc_id"]: r for r in near_duplicates(df, num=num).collect()}
    want, sets = classes(texts, num)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (want[i] == i) for i, s in enumerate(sets))


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_duplicate_rows(df).collect())
    assert got == [(-1, 2, False), (2, 2, True), (4, 2, False), (4, 2, False)]
    assert near_duplicate_rows(df.where("false")).count() == 0


def test_rows_that_repeat_an_id_or_have_none(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    rows = [(7, "a b c d e f", "x"), (7, "g h i j k l", "x"), (7, "g h i j k l", "x"), (3, "g h i j k l", "x"), (None, "m n o p q", "x"), (None, "m n o p q", "x"), (None, None, "x"), (8, "", "x"), (9, long, "x"), (10, long + " end", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"], r["first"]) for r in near_duplicate_rows(df).collect())
    assert got == [
        (0, 0, 0, True, True), (0, 1, 0, False, False), (0, 1, 0, True, True), (3, 2, 3, True, True), (7, 2, 3, False, False), (7, 2, 3, False, False), (7, 2, 7, True, True),
        (8, 0, 8, True, True), (9, 5000, 9, True, True), (10, 5001, 9, False, False),
    ]


def test_pigeonhole_keeps_every_pair_under_the_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (200, SIZE)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(SIZE, DISTANCE, replace=False)
        row[at] ^= 1 + rng.integers(0, 1 << 15, DISTANCE).astype(np.uint16)
    assert DISTANCE == 2 * CHUNKS - 1
    assert (bucket_keys(a) == bucket_keys(b)).any(1).all()


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n in (1, 30, 400, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, max(1, n // 12)).astype(np.uint64)]))
        x, y = unpack([signature(a)]), unpack([signature(b)])
        apart = len(np.setxor1d(a, b))
        both = len(np.intersect1d(a, b))
        assert distances(x, y)[1][0] <= apart
        for num in (80, 85):
            if both * 100 >= num * (len(a) + len(b) - both):
                assert close(x, y, np.array([len(a) + len(b)]), num, 100)[0] or distances(x, y)[0][0] > DISTANCE


def test_a_group_of_texts_just_too_different_to_link(spark):
    """Many candidates, few links: every pair shares about three quarters."""
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in rnd.sample(range(200), 6 + k % 3):
            words[at] = f"x{k}_{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for num in (70, 80):
        got = [r["component_id"] for r in near_duplicate_rows(df, num=num).orderBy("doc_id").collect()]
        assert got == classes(texts, num)[0]


@pytest.mark.parametrize("few", [0, 4])
def test_later_rounds_deal_only_rows_with_candidates(spark, monkeypatch, few):
    """Texts that share buckets but lie beyond the bound are dealt once; results are those of brute force with and without rounds."""
    monkeypatch.setattr(minhash, "LINEAR", 0)
    monkeypatch.setattr(minhash, "FEW", few)
    dealt, across = [], minhash._across
    monkeypatch.setattr(minhash, "_across", lambda rows, *a: (dealt.append((rows.count(), a[-1])), across(rows, *a))[1])
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    far = []
    for k in range(40):
        words = list(base)
        for at in rnd.sample(range(200), 14):
            words[at] = f"x{k}_{at}"
        far.append(" ".join(words))
    for texts in (far, far + some_texts()):
        dealt.clear()
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = [r["component_id"] for r in near_duplicate_rows(df, num=80).orderBy("doc_id").collect()]
        assert got == classes(texts, 80)[0]
        assert dealt[0][1] and sum(n for n, _ in dealt[1:]) < dealt[0][0] / 2


def test_many_equal_rows_are_linear(spark):
    """Copies of one text fold at once; all of them lose all of it, and what it shares with others goes there too."""
    text = " ".join(f"t{k}" for k in range(150))
    rows = [(1, text)] * 600 + [(None, text)] * 200 + [(2, text[100:400] + " and more of its own"), (3, "a text alone " * 30)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r["n_removed"], r["n_spans"]) == (r["n_bytes"], 1) for r in got if r["doc_id"] in (1, None)) and len(got) == 802
    assert next(r for r in got if r["doc_id"] == 2)["n_removed"] == 300


def test_splitting_keeps_windows_at_their_offsets():
    rnd = random.Random(2)
    region = bytes(rnd.randrange(256) for _ in range(260))
    for step in suffix.SPLITS:
        keys, codes, first, left, parts = suffix.split(5, 60, region, step)
        assert first[0] == 0 and sum(len(p) - suffix.WINDOW + 1 for p in parts) == 61
        assert all(region[f : f + len(p)] == p and f + at == 60 for f, at, p in zip(first, left, parts)) and len(set(keys)) == len(keys)


def test_suffix_array_equals_sorting():
    rnd = random.Random(4)
    for _ in range(500):
        s = [rnd.randint(1, rnd.randint(1, 5)) for _ in range(rnd.randint(0, 40))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def without_repeats(bodies, w=200):
    seen: dict[bytes, int] = {}
    for b in bodies:
        for p in range(len(b) - w + 1):
            seen[b[p : p + w]] = seen.get(b[p : p + w], 0) + 1
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - w + 1):
            if seen[b[p : p + w]] > 1:
                gone[p : p + w] = True
        out.append((bytes(x for x, g in zip(b, gone) if not g), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())))
    return out


@pytest.mark.parametrize("block, segment", [(32768, 1 << 20), (2, 700)])
def test_remove_repeats_equals_brute_force(spark, monkeypatch, block, segment):
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "SEGMENT", segment)
    rnd = random.Random(9)
    some = lambda n: "".join(rnd.choice("abc dé\n") for _ in range(n))
    p, q = some(200), some(330)
    texts = [None, "", "short", some(500), some(199)]
    texts += [some(rnd.randint(0, 150)) + p + some(rnd.randint(0, 150)) for _ in range(5)]
    texts += [some(50) + q[k:] + some(rnd.randint(0, 80)) + p[:195] for k in (0, 40, 131, 140)]
    texts += ["Der " * 300, "x" * 450, q + some(900) + q, some(900)] + [some(600)] * 3
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)] + [(99, texts[3], "b")], "doc_id long, text string, body string")
    texts = texts + [texts[3]]
    got = {r["doc_id"]: r for r in remove_repeats(df, with_text=True).collect()}
    for i, (b, (rest, n, k)) in enumerate(zip(texts, without_repeats([(t or "").encode() for t in texts]))):
        r = got[99 if i == len(texts) - 1 else i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len((b or "").encode()), n, k, hashlib.sha256(rest).hexdigest())
    assert remove_repeats(df.where("false")).count() == 0


def test_pipeline_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    text, other = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta"))
    rows = [(2, text), (1, text), (1, text), (1, text + " more"), (None, text), (None, other), (None, other), (3, "gamma delta epsilon zeta eta theta"), (4, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, (r["text"] or "").split(" ")[0]) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == [(0, ""), (0, "beta0"), (1, "alpha0"), (3, "gamma"), (4, "")]

"""Personal data, top-k search, audio fingerprints and the pipeline."""

import hashlib
import io
import itertools
import re
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import media, pii, topk
from tripleloom.llm.topk import CoverTree, Points, search, top_k

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(x):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


TEXTS = [
    None, "", "a@b.c_d@e.f", "x@y..z@q.r", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.002.3.255", "4" * 30, "4111 1111 1111 1111 4111-1111-1111-1111", "+49 30 1234 5678 9012 3456",
    "@@@a@b.c.", "😀 a@b.co 😀 +1 (234) 567-8901", "1" * 9000, "a" * 9000, "1-" * 6000, "a@" + "b." * 6000, "call (030) 123-4567 now", "mail me: anna (at) example (dot) com please", "10.0.0.1 or +1 702 555 0742.", "the year 2001-02-03",
]


def test_base_spans_and_additions(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in pii.report(pii.find(df)).collect()}
    for i, t in enumerate(TEXTS):
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if good(kind, m[0]))
        text = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert all(got[i][f"n_{kind}"] == sum(w[3] == kind for w in want) for kind in PATTERNS)
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    assert got[15]["spans"].startswith("phone:") and got[16]["spans"].startswith("email:") and got[18]["spans"] == ""
    plan = pii.find(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("RDD scan", ""))


def test_redact(spark):
    df = spark.createDataFrame([(i, t, "de", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got[0] is None and got[1] == "" and got[2] == "[EMAIL][EMAIL]" and got[17] == "[IP] or [PHONE]."
    assert got[10] == "😀 [EMAIL] 😀 [PHONE]" and got[18] == TEXTS[18]
    assert pii.redact(df.where("false")).columns == df.columns


def brute(x, k, every):
    out = {}
    for i, v in x.items():
        if i % every == 0:
            out[i] = sorted((-int(np.dot(v, w)), j) for j, w in x.items() if j != i)[:k]
    return out


def test_search_equals_brute_force():
    rng = np.random.default_rng(1)
    for n, d in ((300, 3), (60, 8), (5, 2)):
        x = rng.integers(-4, 5, (n, d))
        rows, ids, score = search(x[::7], np.arange(n)[::7], np.full(len(x[::7]), -(2.0**62)), Points(x, np.arange(n)), 20)
        got: dict = {}
        for r, i, s in zip(rows, ids, score):
            got.setdefault(int(r) * 7, []).append((-int(s), int(i)))
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in brute(dict(enumerate(x)), 20, 7).items() if v}
    tree = CoverTree(rng.normal(size=(500, 4)))
    for centre, _, radius, a, b, _ in tree.nodes:
        assert (np.sqrt(((tree.x[tree.order[a:b]] - centre) ** 2).sum(1)) <= radius + 1e-9).all()


def test_top_k_over_a_frame(spark):
    rng = np.random.default_rng(2)
    vecs = {i: rng.normal(size=6).astype(np.float32).tolist() for i in range(120)} | {i: [0.5] * 6 for i in range(120, 160)}
    bad = [(1000, None), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] * 6), (1060, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in [*vecs.items(), *bad]], "vec_id long, embedding array<float>, score double")
    got: dict = {}
    for r in top_k(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got == brute({i: np.floor(64 * np.array(v, float)).astype(int) for i, v in vecs.items()}, 20, 20)
    assert top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_in_many_cells_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "GROUP", 2)
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 30, (5, 4))
    vecs = {i: (centres[i % 5] + rng.normal(0, 0.2, 4)).tolist()[: 4 if i % 9 else 2] for i in range(400)}
    df = spark.createDataFrame([(i, v) for i, v in vecs.items()], "vec_id long, embedding array<double>")
    full = {i: np.floor(64 * np.array(v + [0.0] * (4 - len(v)))).astype(int) for i, v in vecs.items()}
    got: dict = {}
    for r in top_k(df, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got == brute(full, 7, 20)
    cells = [{"cell": c, "q_n": 1, "q_far": 1.0, "far": 1.0, "floor": 50.0} for c in range(2)]
    assert topk._meeting(cells, np.array([[10.0, 0.0], [0.0, 10.0]])) == [(0, 0), (1, 1)]


def test_top_k_of_an_id_with_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(20, rng.normal(size=3).tolist()) for _ in range(30)] + [(7, rng.normal(size=3).tolist()) for _ in range(30)]
    x = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    got: dict = {}
    for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    for q in (0, 20, 40):
        best: dict = {}
        for i, v in x:
            if i != q:
                best[i] = max([best.get(i, -(10**9)), *(int(v @ w) for j, w in x if j == q)])
        assert got[q] == sorted((-s, i) for i, s in best.items())[:5]


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(6)
    vecs = {i: rng.normal(size=6).astype(np.float32).tolist() for i in range(100)} | {i: [0.5] * 6 for i in range(100, 130)}
    rows = [(i, v) for i, v in vecs.items() for _ in range(25 if i == 100 else 2)]
    got: dict = {}
    for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got == brute({i: np.floor(64 * np.array(v, float)).astype(int) for i, v in vecs.items()}, 20, 20)


def tone(notes, rate=8000, seconds=0.4):
    t = np.arange(int(rate * seconds)) / rate
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in notes])


def as_wave(x, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 20000).astype("<i2").tobytes())
    return out.getvalue()


def test_fingerprints_align_recordings(spark):
    rng = np.random.default_rng(3)
    song = tone(rng.integers(0, 24, 40))
    other = tone(rng.integers(0, 24, 40))
    cut = song[media.HOP * 20 :] + rng.normal(0, 0.01, len(song) - media.HOP * 20)
    a, b = media.fingerprint(as_wave(song)), media.fingerprint(as_wave(cut))
    offset, overlap, error = media.align(a, b)
    assert offset == 20 and error < 0.1 and overlap == len(b)
    rows = [(1, as_wave(song)), (2, as_wave(cut)), (3, as_wave(other)), (4, as_wave(song)), (5, None), (6, b""), (7, b"\x80" * 20000), (8, b"abc")]
    got = {r["id"]: r for r in media.match(spark.createDataFrame(rows, "page_id long, html binary"), "page_id", "html").collect()}
    assert len(got) == 8 and got[2]["match_id"] == 1 and got[4]["match_id"] == 1 and got[3]["match_id"] is None
    assert got[5]["n_codes"] == got[6]["n_codes"] == got[8]["n_codes"] == 0 and got[7]["n_codes"] > 0


def test_partner_behind_smaller_recordings(spark):
    rng = np.random.default_rng(3)
    song = tone(rng.integers(0, 24, 40))
    cut = song[media.HOP * 20 :] + rng.normal(0, 0.01, len(song) - media.HOP * 20)
    # unrelated recordings of smaller ids that hold every passage of the song between them
    rows = []
    for k, at in enumerate(range(0, len(song) // media.HOP, 20)):
        around = [tone(rng.integers(0, 24, 20)) for _ in range(2)]
        around = [x[: len(x) // media.HOP * media.HOP] for x in around]
        rows.append((k, as_wave(np.concatenate([around[0], song[at * media.HOP : (at + 36) * media.HOP], around[1]]))))
    rows += [(100, as_wave(song)), (101, as_wave(cut))]
    codes = {i: set(media.fingerprint(x).tolist()) for i, x in rows}
    small = set().union(*(codes[k] for k, _ in rows[:-2]))
    assert codes[101] & codes[100] <= small  # the true partner is the smallest of no bucket
    got = {r["id"]: r for r in media.match(spark.createDataFrame(rows, "page_id long, html binary"), "page_id", "html").collect()}
    assert got[101]["match_id"] == 100 and got[101]["offset"] == 20


@pytest.mark.parametrize("shared", [10, 25])
def test_partners_among_songs_that_share_an_opening(spark, shared):
    """Recall against judging every pair: who has a match, and which is the best."""
    rng = np.random.default_rng(7)
    opening, rows, want = rng.integers(0, 24, shared), [], {}
    for k in range(20):
        song = tone(np.concatenate([opening, rng.integers(0, 24, 40 - shared)]))
        cut = song[media.HOP * int(rng.integers(0, 30)) :]
        rows += [(k, as_wave(song)), (100 + k, as_wave(cut + rng.normal(0, 0.02, len(cut))))]
        want[100 + k] = k
    got = {r["id"]: r["match_id"] for r in media.match(spark.createDataFrame(rows, "page_id long, html binary"), "page_id", "html").collect()}
    codes = {i: media.fingerprint(x) for i, x in rows}
    judged = {i: [(a[2], j) for j in codes if j < i and (a := media.align(codes[j], codes[i])) and a[2] <= media.MAX_ERROR and a[1] >= media.MIN_OVERLAP] for i in codes}
    assert all((got[i] is None) == (not found) for i, found in judged.items())
    assert sum(got[i] == (min(found)[1] if found else None) for i, found in judged.items()) >= 0.8 * len(judged)
    assert all(got[i] == k for i, k in want.items())


def links_of(rows):
    """id: (linked fingerprints, component) by judging every pair of different fingerprints."""
    first, codes = {}, {}
    for i, raw in rows:
        c = media.fingerprint(raw)
        if i is not None and len(c):
            first[c.tobytes()] = min(i, first.get(c.tobytes(), i))
            codes[c.tobytes()] = c
    order = sorted(first, key=first.get)
    links, root = {k: 0 for k in order}, {k: k for k in order}
    for y, x in itertools.combinations(order, 2):
        a = media.align(codes[y], codes[x])
        if a and a[2] <= media.MAX_ERROR and a[1] >= media.MIN_OVERLAP:
            links[x] += 1
            links[y] += 1
            old, new = root[x], root[y]
            root = {k: new if r == old else r for k, r in root.items()}
    least = {k: min(first[j] for j in order if root[j] == root[k]) for k in order}
    keys = [(i, media.fingerprint(raw).tobytes()) for i, raw in rows]
    return sorted((i, links.get(k, 0), least.get(k, i)) if i is not None else (-1, 0, None) for i, k in keys)


@pytest.mark.parametrize("block", [media.BLOCK, 3])
def test_every_link_of_a_recording_counts(spark, monkeypatch, block):
    """Songs that share an opening, cuts, copies and short ones: links and classes as by judging every pair."""
    monkeypatch.setattr(media, "BLOCK", block)
    rng = np.random.default_rng(11)
    opening, rows = rng.integers(0, 24, 12), []
    for k in range(8):
        song = tone(np.concatenate([opening, rng.integers(0, 24, int(rng.integers(4, 20)))]))
        for c in range(3):
            cut = song[media.HOP * int(rng.integers(0, 20)) :]
            rows.append((10 * k + c, as_wave(cut + rng.normal(0, 0.02, len(cut)))))
    rows += [(300, rows[4][1]), (301, rows[4][1]), (302, None), (None, rows[0][1]), (303, as_wave(tone([3], seconds=0.7))), (304, as_wave(tone([5] * 5))), (305, as_wave(tone([5] * 9)))]
    rows += [(10, as_wave(tone(rng.integers(0, 24, 20)))), (306, rows[-1][1])]  # an id of two recordings
    df = spark.createDataFrame(rows, "page_id long, html binary")
    got = sorted((-1 if r["id"] is None else r["id"], r["n_links"], r["component_id"]) for r in media.match(df, "page_id", "html").collect())
    assert got == links_of(rows)
    assert max(n for _, n, _ in got) > 2


def test_many_alignments_at_once_equal_single_ones():
    rng = np.random.default_rng(6)
    codes = [rng.choice([0, 0, 1, 2, *range(3, 20), 2**32 - 1], n).astype(np.uint32) for n in (1, 4, 5, 16, 17, 63, 70, 300, 1500)]
    wide = np.full((len(codes), 1500), -1, np.int64)
    for r, c in enumerate(codes):
        wide[r, : len(c)] = c
    for mine in codes:
        k, over, wrong = media.align_many(wide, np.array([len(c) for c in codes]), mine.astype(np.int64))
        for r, c in enumerate(codes):
            if one := media.align(c, mine):
                assert one == (k[r], over[r], wrong[r] / (32 * over[r]))


def test_wave_codings_decode_alike():
    x = (np.sin(np.arange(4000) / 9) * 0.7).astype(np.float64)
    def wav(coding, bits, body):
        head = struct.pack("<HHIIHH", coding, 1, 8000, 8000 * bits // 8, bits // 8, bits)
        return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body
    wide = (x * 2**31).astype("<i4")
    forms = {8: wav(1, 8, (x * 127 + 128).astype(np.uint8).tobytes()), 16: wav(1, 16, (x * 32767).astype("<i2").tobytes()), 24: wav(1, 24, wide.view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()), 32: wav(1, 32, wide.tobytes()), 33: wav(3, 32, x.astype("<f4").tobytes())}
    for bits, raw in forms.items():
        got, rate = media.decode(raw)
        assert rate == 8000 and len(got) == len(x) and np.abs(got - x).max() < (0.02 if bits == 8 else 1e-3)
    assert len(media.decode(wav(85, 0, b"abc"))[0]) == 0 and media.decode(b"RIFFxxxxWAVE")[0].size == 0


def test_media_edges(spark):
    df = spark.createDataFrame([(None, b"\x80" * 9000, 1), (1, b"\x80" * 9000, 1), (1, b"\x80" * 9000, 1)], "page_id long, html binary, offset int")
    got = sorted(((r["id"] or 0), r["match_id"], r["bit_error"]) for r in media.match(df, "page_id", "html").collect())
    assert got == [(0, None, None), (1, None, None), (1, None, None)]
    assert media.match(df.where("false"), "page_id", "html").count() == 0


def test_every_place_of_an_integer_votes():
    a, b = np.concatenate([np.arange(1, 31), np.zeros(20)]).astype(np.uint32), np.zeros(20, np.uint32)
    assert media.align(a, b) == (30, 20, 0.0)
    rng = np.random.default_rng(5)
    for n in (7, 60, 3000):  # with and without integers of very many pairs of places
        a, b = (rng.choice([0, 0, 0, 1, 2, *range(3, 50)], m).astype(np.uint32) for m in (n, n // 2 + 1))
        votes = np.unique(np.subtract.outer(np.arange(len(a)), np.arange(len(b)))[a[:, None] == b[None, :]], return_counts=True)
        got = media.align(a, b)
        assert got is None if not len(votes[0]) else got[0] == votes[0][votes[1].argmax()]


def test_integral_image_sums():
    image = np.random.default_rng(4).random((30, 12)).astype(np.float32)
    assert len(media.pack(image)) == 30 - media.SPAN + 1 and len(media.pack(image[:3])) == 0
    assert len(media.filters()) == 16


def test_pipeline_on_the_smallest_tables(spark):
    import os

    import corpus_pipeline

    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001").persist()
        assert tuple(kept.columns) == corpus_pipeline.COLUMNS, name
    out = corpus_pipeline.packing(spark, kept, "")
    assert out.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count() <= docs.count()

"""The contract queries and the stages of the pipeline, on tables with every odd row, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from test_dedup import classes, without_repeats
from test_pii_topk_media import PATTERNS, good
from tripleloom.llm import media, pii
from tripleloom.llm.langid import LangId
from tripleloom.llm.quality import Quality
from tripleloom.llm.queries import QUERIES
from tripleloom.llm.toxicity import Toxicity

KINDS = {"en": "the of and ing tion er", "de": "der und sch keit ung ein", "fr": "le de eau oir ment que"}


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(KINDS[lang].split()) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def documents():
    rnd = random.Random(12)
    rows = []
    for i in range(150):
        lang = rnd.choice(sorted(KINDS))
        words = sentence(rnd, lang, rnd.randint(10, 90)).split()
        if i % 5 == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "worthless"]))
        if i % 7 == 0:
            words = [w + "###" for w in words]
        if i % 11 == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(["a.b@example.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (234) 567-8901", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']))
        rows.append((i, " ".join(words), lang))
    passage = sentence(rnd, "en", 60)
    for i in (3, 40, 77):
        rows[i] = (i, sentence(rnd, "en", 5 + i) + " " + passage + " " + sentence(rnd, "en", 9), "en")
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(0, 40, 8)]  # copies
    near = rows[8][1].split()
    rows += [(300 + k, " ".join([*near[:k], "changed", *near[k + 1 :]]), "en") for k in range(4)]
    rows += [(400, None, "en"), (401, "", "de"), (402, "  \n", None), (403, "12 ½ ²", "fr"), (404, sentence(rnd, "de", 30_000), "de"), (405, "x" * 9000, None), (None, "no id here at all", "en"), (None, None, None), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    rows = documents()
    n = len(rows)
    odd = {c: pa.array(np.arange(n, dtype=float)) for c in ("score", "length", "kept", "component_id", "spans", "d", "label", "offset", "n", "body")}
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": pa.array(["s"] * n), "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64()), **odd}), where / "documents.parquet")
    ids = [r[0] for r in rows[:150]] + [None, 7, 400, 5000]
    text = {r[0]: r[1] or "" for r in rows}
    quality = [None if i is None else int("###" not in text.get(i, "")) for i in ids]
    toxic = [None if i is None or i == 9 else int(bool(re.search("idiot|worthless", text.get(i, "")))) for i in ids]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(quality, pa.int64()), "toxic": pa.array(toxic, pa.int64()), "text": pa.array(["clash"] * len(ids))}), where / "labels.parquet")
    rng = np.random.default_rng(4)
    vecs = [rng.normal(size=5).tolist() for _ in range(90)] + [None, [1.0, None, 0.0, 0.0, 0.0], [float("inf")] * 5, [0.5] * 5, [0.5] * 5]
    pq.write_table(pa.table({"vec_id": pa.array([*range(90), 100, 120, 140, 160, 161], pa.int64()), "embedding": pa.array(vecs, pa.list_(pa.float32())), "score": pa.array(np.zeros(95))}), where / "embeddings.parquet")
    tone = lambda k: ((np.sin(np.arange(24_000) * (0.02 + 0.01 * (k % 5))) + np.sin(np.arange(24_000) ** 1.3 * 0.002 * (k + 1))) * 60 + 128).astype(np.uint8).tobytes()
    pages = [(k, tone(k // 2) if k % 3 else tone(k)) for k in range(12)] + [(50, None), (51, b""), (None, tone(1)), (3, tone(3))]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "html": pa.array([p[1] for p in pages], pa.binary()), "n": pa.array([0] * len(pages)), "id": pa.array([1] * len(pages))}), where / "pages.parquet")
    return str(where), rows


def empty(tables, tmp_path):
    """The same tables without a row."""
    for name in ("documents", "labels", "embeddings", "pages"):
        pq.write_table(pq.read_table(f"{tables[0]}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def key(r):
    return tuple((x is None, 0 if x is None else x) for x in r)


def rows_of(spark, tables, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, tables[0]).collect()), key=key)


def part(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, tables, tmp_path, name):
    assert QUERIES[name](spark, empty(tables, tmp_path)).collect() == []


def test_op1(spark, tables):
    rows = tables[1]
    root, sets = classes([r[1] for r in rows], 85)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(least.get(root[k], r[0]), r[0])
    got = rows_of(spark, tables, "op1_minhash_dedup", "doc_id", "n_shingles", "component_id")
    assert got == sorted([(r[0], len(sets[k]), least.get(root[k])) for k, r in enumerate(rows)], key=key)
    kept = QUERIES["op1_minhash_dedup"](spark, tables[0]).where("doc_id is not null").select("doc_id", "component_id", "kept").collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in kept)


def base(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(kind, m[0]))


def test_op2(spark, tables):
    want = []
    for i, t, _ in tables[1]:
        found = base(t or "")
        want.append((i, *(sum(f[3] == kind for f in found) for kind in PATTERNS), hashlib.sha256(",".join(f"{f[3]}:{f[0]}:{f[2]}" for f in found).encode()).hexdigest()))
    assert rows_of(spark, tables, "op2_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=key)


def test_op3(spark, tables):
    plain = without_repeats([(t or "").encode() for _, t, _ in tables[1]])
    want = [(r[0], len((r[1] or "").encode()), n, k, hashlib.sha256(rest).hexdigest()) for r, (rest, n, k) in zip(tables[1], plain)]
    assert rows_of(spark, tables, "op3_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=key)


def test_op4(spark, tables):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    streams = sorted((key((i,)), tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in tables[1])
    got = QUERIES["op4_packing"](spark, tables[0]).collect()
    assert sum(r["length"] for r in got) == sum(len(s) for _, s in streams)
    by = {}
    for r in got:
        by.setdefault((key((r["doc_id"],)), r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for k, s in streams:
        for at, n, crc in by[k, len(s)]:
            assert any(zlib.crc32(np.array(o[at : at + n], "<u4").tobytes()) == crc for j, o in streams if (j, len(o)) == (k, len(s)))
    for seq in {r["sequence_id"] for r in got}:
        mine = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == seq)
        assert [o for o, _ in mine] == np.concatenate([[0], np.cumsum([n for _, n in mine])[:-1]]).tolist() and sum(n for _, n in mine) <= 2048


def test_op5(spark, tables):
    t = pq.read_table(f"{tables[0]}/embeddings.parquet").to_pydict()
    x = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in zip(t["vec_id"], t["embedding"]) if v and all(c is not None and np.isfinite(c) for c in v)}
    want = [(i, k + 1, j, -s) for i in x if i % 20 == 0 for k, (s, j) in enumerate(sorted((-int(x[i] @ x[j]), j) for j in x if j != i)[:20])]
    assert rows_of(spark, tables, "op5_topk", "query_id", "rank", "vec_id", "score") == sorted(want)


def test_op6(spark, tables):
    t = pq.read_table(f"{tables[0]}/pages.parquet").to_pydict()
    codes = [media.fingerprint(x) for x in t["html"]]
    got = sorted(((r["page_id"], r["n_codes"], r["fingerprint_sha256"], r["match_id"]) for r in QUERIES["op6_media"](spark, tables[0]).collect()), key=key)
    assert [g[:3] for g in got] == sorted([(i, len(c), hashlib.sha256(c.astype("<u4").tobytes()).hexdigest()) for i, c in zip(t["page_id"], codes)], key=key)
    first = {}
    for i, c in zip(t["page_id"], codes):
        if i is not None and len(c):
            first[c.tobytes()] = min(i, first.get(c.tobytes(), i))
    reps = {first[c.tobytes()]: c for i, c in zip(t["page_id"], codes) if i is not None and len(c)}
    for i, n, sha, match in got:
        if i is None or not n:
            assert match is None
            continue
        mine = next(c for j, c in zip(t["page_id"], codes) if j == i)
        if first[mine.tobytes()] != i:
            assert match == first[mine.tobytes()]
            continue
        found = [(a[2], j) for j, c in reps.items() if j < i and (a := media.align(c, mine)) and a[2] <= media.MAX_ERROR and a[1] >= media.MIN_OVERLAP]
        assert (match is None) == (not found) and (match is None or match in {j for _, j in found})


def test_op7(spark, tables):
    got = rows_of(spark, tables, "op7_language_id", "doc_id", "held_out", "lang_pred", "score")
    assert [g[0] for g in got] == sorted([r[0] for r in tables[1]], key=lambda i: key((i,)))
    lang = {r[0]: r[2] for r in tables[1] if r[0] is not None and r[0] < 150 and "###" not in r[1]}
    held = [g for g in got if g[1] and g[0] in lang]
    assert held and all(g[2] == lang[g[0]] for g in held) and all(g[1] == (part(g[0], 4) == 2) for g in got if g[0] is not None)
    pred = {g[0]: g[2] for g in got}
    assert [pred[i] for i in (400, 401, 402, 403)] == ["und"] * 4 and pred[404] == "de" and all(0 <= g[3] <= 1 for g in got)
    texts = spark.read.parquet(f"{tables[0]}/documents.parquet")
    model = LangId().fit(texts.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    counts = {}
    for i, t, x in tables[1]:  # every training row counts, copies too
        if i is not None and t is not None and x is not None and part(i, 4) != 2:
            counts[x] = counts.get(x, 0) + 1
    assert np.allclose(model.prior, np.log([(counts[x] + 1) / sum(c + 1 for c in counts.values()) for x in model.languages]))


@pytest.mark.parametrize("name, cut, bad", [("op8_toxicity", 0.5, "idiot|worthless"), ("op9_quality", 0.3, "###")])
def test_op8_op9(spark, tables, name, cut, bad):
    got = rows_of(spark, tables, name, "doc_id", "held_out", "score", "predicted")
    assert [g[0] for g in got] == sorted([r[0] for r in tables[1]], key=lambda i: key((i,)))
    assert all(g[1] == (part(g[0], 5) == 0) for g in got if g[0] is not None) and all(0 <= g[2] <= 1 and g[3] == int(g[2] >= cut) for g in got)
    text = {r[0]: r[1] for r in tables[1] if r[0] is not None and r[0] < 150}
    want = lambda i: int(bool(re.search(bad, text[i]))) if name == "op8_toxicity" else int("###" not in text[i])
    held = [(g[3], want(g[0])) for g in got if g[1] and g[0] in text]
    assert len(held) > 15 and sum(a == b for a, b in held) >= 0.9 * len(held)


def test_op10(spark, tables):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t, _ in tables[1]:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert rows_of(spark, tables, "op10_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=key)


def test_toxicity_reads_more_than_the_worst_word():
    texts = [r[1] for r in documents()[:150]]
    model = Toxicity().fit_rows(texts, [int(bool(re.search("idiot|worthless", t))) for t in texts])
    score = model.scorer()
    mixed = ["the of idiot and tion", "der idiot und keit ung", "idiot", "the of and tion er"]
    alone = [max(score([w])[0] for w in t.split()) for t in mixed]
    assert all(abs(a - b) > 1e-6 for a, b in zip(score(mixed)[:2], alone)) and score(mixed)[0] > 0.5 > score(mixed)[3]
    one, two = score(["the of and er tion ing idiot", "idiot ing the er of and tion"])
    assert one != two  # neighbours count


def test_trees_select_among_candidates(spark):
    """What the trees add and refuse, on forms and words that their examples do not have."""
    yes = ['secret_token: "Zk39fPq0aLm2XyTt81BvCw55"', "my password is = 9f8e7d6c5b4a39281706f5e4d3c2b1a0", "ring (0170) 555-0199 please call", "mobile 0151 2345 6789.", "reach me via mail: j.smith (at) somewhere (dot) net now"]
    no = ["see file summer-house-guide-2019 there", "commit 9f8e7d6c5b4a39281706f5e4d3c2b1a0 fixed it", "on 2019-10-22 we went", "the article 12-345-678-90 in order", "walked at home.then left"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(yes + no)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(df)).collect()}
    cand = {r["doc_id"]: r["n"] for r in df.selectExpr("doc_id", "text").select("doc_id", pii.F.size(pii.candidates(pii.F.col("text"))).alias("n")).collect()}
    assert sum(bool(got[i]) for i in range(len(yes))) >= 4 and sum(bool(got[len(yes) + i]) for i in range(len(no))) <= 1
    assert sum(cand[len(yes) + i] > 0 for i in range(len(no))) >= 3  # refused, not unseen


def test_every_stage_against_a_plain_version(spark, tables):
    from tokenizers import Tokenizer

    sf, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    model = Quality(metadata=("n_chars",)).fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()]
    score = model.scorer()([t for _, t, _ in rows], np.array([[np.nan if n is None else n] for _, _, n in rows], float))
    rows = [r[:2] for r in rows]
    rows = [r for r, s in zip(rows, score) if s >= corpus_pipeline.QUALITY_THRESHOLD]
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=key)
    assert texts(kept) == sorted(rows, key=key) and 100 < len(rows) < 175
    one = corpus_pipeline.near_dedup(spark, kept, sf)
    root, _ = classes([t for _, t in rows], 80)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(root[k], []).append(r)
    got = texts(one)
    assert len(got) == len(groups)
    ids = lambda g: [i for i, _ in g if i is not None]
    assert sorted([(min(ids(g)) if ids(g) else None,) for g in groups.values()], key=key) == [(i,) for i, _ in got]
    assert all((i, t) in rows for i, t in got)
    cut = corpus_pipeline.suffix_dedup(spark, one, sf)
    plain = without_repeats([(t or "").encode() for _, t in got])
    want = sorted(((i, rest.decode("utf-8", "ignore")) for (i, _), (rest, _, _) in zip(got, plain)), key=key)
    assert texts(cut) == want and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    clean = corpus_pipeline.pii(spark, cut, sf)
    spans = {(r["doc_id"], r["body"]): r["spans"] for r in pii.find(cut).select("doc_id", "body", "spans").collect()}

    def without(i, t):
        out, at = [], 0
        flat = []
        for s in spans[i, t]:
            if flat and flat[-1][1] > s["s"]:
                flat[-1][1] = max(flat[-1][1], s["e"])
            else:
                flat.append([s["s"], s["e"], pii.KINDS[s["k"]]])
        for s, e, kind in flat:
            out += [t[at:s], f"[{kind.upper()}]"]
            at = e
        return "".join(out) + t[at:]

    assert texts(clean) == sorted([(i, without(i, t)) for i, t in want], key=key)
    assert not any(base(t) for _, t in texts(clean))
    packed = corpus_pipeline.packing(spark, clean, sf).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in packed) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts(clean))
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)


def test_stages_take_empty_and_odd_rows(spark, tables, tmp_path):
    sf = empty(tables, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.collect() == [], name
        docs = out if name != "packing" else docs
    assert corpus_pipeline.run(spark, sf).collect() == []

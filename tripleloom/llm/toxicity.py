"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams (3, 4, 6 and 8 bytes, and
the whole word), so a misspelling nobody has seen shares most of its vector with the
word it distorts. At each word the vectors of it and its neighbours are averaged with the
weights of ``KERNEL``, and these means over the whole text with weights of their own, the
softmax of their logits: one insult counts in a text of any length, and every word counts
a little. The mean goes through a linear softmax of two classes. Embeddings, outputs and
biases are trained together, the weighting included; its sharpness rises from an even mean
to that of scoring.

The model is fitted on the driver, on a bounded sample of the labelled rows
(``PER_CLASS`` of each class, the smallest by a hash of the id, texts of up to ``SAMPLE_CHARS``
characters), weighted back to the classes' shares of all labelled rows, and broadcast; its
size is fixed by ``BITS`` and ``DIM``. Scoring is one pass over whole texts, each distinct word
of a task once.

Defined cases: a null or empty text, or one without words, is scored by the bias alone; rows
without label or text teach nothing; with no training rows the score is 0 for all, with one
class alone its own; a document id with several labels counts once for each, rows that
repeat an id and label teach by the smallest of their texts and are scored each; equal ids
in the sample's order cannot occur, equal hashes go by id; very long texts are scored in
whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Vocab, doc_words, ngram_buckets, segment_sum, ship, slices, text_chunks

ORDERS, BITS, DIM = (3, 4, 6, 8), 18, 8
#: Weights of a word and of its neighbours one and two words away, on either side; they add up to 1.
KERNEL, SHARPNESS = (0.5, 0.15, 0.1), 1.0
PER_CLASS, SAMPLE_CHARS = 1200, 1 << 17
STEPS, RATE, L2, DROP, MIN_COUNT = 100, 0.05, 1e-5, 0.3, 6
#: A run of letters of over 4000 characters counts as several words.
_WORD = re.compile(r"[^\W_]{1,4000}(?:[@$*!][^\W_]{1,4000}){0,20}").findall
#: Look-alike characters.
_LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def words(t: str) -> list[str]:
    return _WORD(t.lower())


def normal(w: str) -> bytes:
    """Look-alikes undone where a word also has letters; runs of three or more equal letters cut to two."""
    if not w.isalpha() and any(c.isalpha() for c in w):
        w = w.translate(_LOOKS)
    return re.sub(r"(.)\1{2,}", r"\1\1", w).encode()


def _bags(ws: list[bytes]):
    return ngram_buckets(ws, ORDERS, BITS, whole=True)


def read(texts, vocab: Vocab, change=None):
    """Word ids and offsets; a word repeated at once counts once, so that no word fills a mean by itself."""
    ids, off = doc_words(texts, (lambda t: [change(w) for w in words(t)]) if change else words, vocab)
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    new[off[:-1][off[:-1] < len(ids)]] = True
    return ids[new], np.concatenate([[0], np.cumsum(new)])[off]


def smooth(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    """At each word the mean over it and its neighbours in its text, weighted by ``KERNEL`` (nothing stands beyond a text's ends)."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out = KERNEL[0] * v
    for k, w in enumerate(KERNEL[1:], 1):
        same = text[k:] == text[:-k]
        out[k:] += w * np.where(same, v[:-k], 0)
        out[:-k] += w * np.where(same, v[k:], 0)
    return out


def pooled(logit: np.ndarray, off: np.ndarray, sharp: float, empty: float):
    """(mean logit of each text, weights of its words): weights are the softmax of ``sharp`` times the logits; ``empty`` for texts without words."""
    full = np.flatnonzero(np.diff(off))
    out = np.full(len(off) - 1, empty)
    if not len(full):
        return out, np.zeros(0)
    at, n = off[:-1][full], np.diff(off)[full]
    r = np.exp(np.clip(sharp * (logit - np.repeat(np.maximum.reduceat(logit, at), n)), -50, 0))
    r /= np.repeat(np.add.reduceat(r, at), n)
    out[full] = np.add.reduceat(r * logit, at)
    return out, r


class Toxicity:
    def __init__(self, seed: int = 5):
        self.seed = seed
        self.word_weight = None

    def fit_rows(self, texts: list[str], labels, weights=None) -> "Toxicity":
        y = np.asarray(labels, float)
        if not len(y) or y.min() == y.max():
            self.embed, self.out, self.bias = np.zeros((1 << BITS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2) + ([0, 0] if len(y) else [0, -50])
            return self
        rnd, rng = random.Random(self.seed), np.random.default_rng(self.seed)
        vocab = Vocab()
        ids, off = read(texts, vocab, lambda w: _distort(w, rnd) if rnd.random() < 0.1 else w)
        # subwords of a few occurrences teach nothing that carries over; n-grams are made twice, so that only those kept are held
        spelled, times = [normal(w) for w in vocab], np.bincount(ids, minlength=len(vocab))
        seen, first = np.zeros(1 << BITS), 0
        for part in slices(spelled):
            flat, at = _bags(part)
            seen += np.bincount(flat, weights=np.repeat(times[first : first + len(part)], np.diff(at)), minlength=1 << BITS)
            first += len(part)
        kept, first = [[np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)]], 0
        for part in slices(spelled):
            flat, at = _bags(part)
            per, ok = np.diff(at), seen[flat] >= MIN_COUNT
            kept.append([x[ok] for x in (flat.astype(np.int32), np.repeat(np.arange(first, first + len(part), dtype=np.int32), per), np.repeat((1 / np.maximum(1, per)).astype(np.float32), per))])
            first += len(part)
        flat, owner, share = (np.concatenate([k[i] for k in kept]) for i in range(3))
        del kept
        text_of = np.repeat(np.arange(len(y)), np.diff(off))
        embed = rng.normal(0, 0.1, (1 << BITS, DIM))
        out = rng.normal(0, 0.3, (DIM, 2))
        bias = np.array([1.0, -1.0])
        used, place = np.unique(flat, return_inverse=True)
        place = place.astype(np.int32)
        del flat
        parts = [slice(a, a + (1 << 20)) for a in range(0, max(1, len(place)), 1 << 20)]  # so that little is held besides the n-grams
        weight = np.ones(len(y)) if weights is None else np.asarray(weights, float)
        weight = weight / weight.sum()
        state = [[np.zeros((len(used), DIM)), np.zeros((len(used), DIM))], [np.zeros_like(out), np.zeros_like(out)], [np.zeros(2), np.zeros(2)]]
        for step in range(STEPS):
            s = share * (rng.random(len(place), np.float32) > DROP) / np.float32(1 - DROP)  # subword dropout: no single one carries a word
            # the softmax of two classes sees a vector only along the difference of the outputs
            diff = out[:, 1] - out[:, 0]
            e = embed[used]
            along = e @ diff
            word = sum(np.bincount(owner[k], weights=s[k] * along[place[k]], minlength=len(vocab)) for k in parts)
            base = bias[1] - bias[0]
            logit = smooth(word[ids], off) + base
            z, r = pooled(logit, off, SHARPNESS * min(1.0, step / (0.5 * STEPS)), base)
            wrong = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
            c = np.bincount(ids, weights=smooth(r * wrong[text_of], off), minlength=len(vocab))
            per_bucket = sum(np.bincount(place[k], weights=s[k] * c[owner[k]], minlength=len(used)) for k in parts)
            g_out = np.outer(e.T @ per_bucket, [-1.0, 1.0]) + L2 * out
            g_embed = per_bucket[:, None] * diff[None, :] + L2 * e
            g_bias = wrong.sum() * np.array([-1.0, 1.0])
            for k, (param, grad) in enumerate(((None, g_embed), (out, g_out), (bias, g_bias))):
                m, q = state[k]
                m *= 0.9
                m += 0.1 * grad
                q *= 0.99
                q += 0.01 * grad * grad
                move = RATE * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(q / (1 - 0.99 ** (step + 1))) + 1e-7)
                if k:
                    param -= move
                else:
                    embed[used] -= move
        known = np.zeros(1 << BITS, bool)
        known[used] = True
        embed[~known] = 0
        self.embed, self.out, self.bias = embed.astype(np.float32), out.astype(np.float32), bias
        return self

    def fit(self, docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> "Toxicity":
        """``docs`` (doc_id, text) joined with ``labels`` (doc_id, label); the rows a caller holds out are not in them."""
        return self.fit_rows(*labelled_sample(docs, labels, text, label, per_class)[:3])

    def scorer(self):
        """text list -> scores, with a word table that lives as long as the closure."""
        # The softmax of two classes needs the difference of the outputs alone
        bucket = self.embed @ (self.out[:, 1] - self.out[:, 0])
        bias = float(self.bias[1] - self.bias[0])
        state = {"vocab": Vocab(), "known": 0, "word": np.zeros(0)}

        def score(texts) -> np.ndarray:
            if state["vocab"].full:
                state.update(vocab=Vocab(), known=0, word=np.zeros(0))
            vocab = state["vocab"]
            ids, off = read(texts, vocab)
            fresh = [normal(w) for w in list(vocab)[state["known"] :]]
            for part in slices(fresh):
                flat, at = _bags(part)
                state["word"] = np.concatenate([state["word"], segment_sum(bucket[flat], at) / np.maximum(1, np.diff(at))])
            state["known"] = len(vocab)
            z, _ = pooled(smooth(state["word"][ids], off) + bias, off, SHARPNESS, bias)
            return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

        return score

    def transform(self, docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
        """``keep`` columns and score."""
        return score_texts(docs, self, text, keep)


def _distort(w: str, rnd: random.Random) -> str:
    """A misspelling of ``w``: a letter dropped, doubled, or swapped with the next."""
    if len(w) < 4:
        return w
    k = rnd.randrange(1, len(w) - 1)
    return rnd.choice((w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :]))


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, label: str, per_class: int, more: tuple = ()):
    """(texts, labels, weights, columns ``more`` as a matrix of doubles): at most ``per_class`` rows of each class, the smallest by a hash of the id, whole texts.

    A row weighs the labelled rows of its class over the sampled ones. Ids are chosen before texts are read; of rows that
    repeat an id the smallest text is taken, and texts of over ``SAMPLE_CHARS`` characters are not, so that the sample is
    bounded whatever the table holds.
    """
    spark = docs.sparkSession
    lab = labels.select("doc_id", F.col(label).cast("int").alias("__y")).where("doc_id is not null and __y in (0, 1)")
    ids = docs.select("doc_id").join(lab, "doc_id")
    count = {r["__y"]: r["count"] for r in ids.groupBy("__y").count().collect()}  # bounded: two classes
    h = F.xxhash64("doc_id", F.lit(11))
    chosen = [ids.where(F.col("__y") == y).distinct().orderBy(h, "doc_id").limit(per_class) for y in (0, 1)]
    got = chosen[0].unionByName(chosen[1]).toArrow()  # bounded: two ints for each of 2 * per_class rows
    if not got.num_rows:
        return [], np.zeros(0), np.zeros(0), np.zeros((0, len(more)))
    pick = spark.createDataFrame(got.to_pandas(), "doc_id long, __y int")
    rows = docs.where(F.col(text).isNotNull() & (F.length(text) <= SAMPLE_CHARS)).select("doc_id", F.struct(F.col(text).alias("t"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(more)]).alias("__r")).join(F.broadcast(pick), "doc_id")
    rows = rows.groupBy("doc_id", "__y").agg(F.min("__r").alias("__r")).select("doc_id", "__y", "__r.*").toArrow()  # bounded: 2 * per_class texts of SAMPLE_CHARS
    order = np.lexsort([rows.column("__y").to_numpy(), rows.column("doc_id").to_numpy()])
    rows = rows.take(pa.array(order))
    y = rows.column("__y").to_numpy()
    weigh = np.array([count.get(k, 0) / max(1, n) for k, n in enumerate(np.bincount(y, minlength=2))])
    extra = [rows.column(f"m{k}").to_numpy().astype(float) for k in range(len(more))]
    return rows.column("t").to_pylist(), y.astype(float), weigh[y], np.stack(extra, 1) if more else np.zeros((len(y), 0))


def score_texts(docs: DataFrame, model, text: str, keep: tuple, more: tuple = ()) -> DataFrame:
    """``keep`` columns and score by ``model.scorer()`` of the text (and of the columns ``more``, as doubles), one pass."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(text).cast("string").alias("__text"), *[F.col(c).cast("double").alias(f"__m{k}") for k, c in enumerate(more)], *keep)
    ddl = ", ".join([f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep] + ["score double"])
    skip = 1 + len(more)

    def run(batches):
        score = shared.value.scorer()
        for b in text_chunks(batches, "__text"):
            extra = [np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:skip]], 1)] if more else []
            yield pa.RecordBatch.from_arrays([*b.columns[skip:], pa.array(score(b.column(0).to_pylist(), *extra), pa.float64())], names=[*b.schema.names[skip:], "score"])

    return src.mapInArrow(run, ddl)

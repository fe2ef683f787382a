"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts of every (language, hashed n-gram) are gathered from all training rows by
one distributed aggregation with map-side sums; the model is a matrix of log
probabilities of ``2**bits`` rows and one column a language, whose size does not
depend on the corpus, and is broadcast. Scoring is sparse: a text's score is the sum
of its n-grams' rows, computed once per distinct word of a task.

Defined cases: letters are the characters of the Unicode letter categories; a null or empty
text or one without a letter is ``und`` with score 0; rows with a null language or null
text teach nothing; with no training rows every text is ``und``; ties go to the language that
sorts first; repeated rows teach and are answered each; a run of over 4000 letters counts as
several words, whole texts of any length are read, in bounded slices of words; an empty
table gives no rows; more than ``MAX_LANGUAGES`` languages are an error; extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Vocab, doc_words, ngram_buckets, out_batch, segment_sum, ship, slices, text_chunks

ORDERS, BITS, ALPHA = (1, 2, 3, 4), 15, 0.5
#: Languages a model may have; more is an error, as the matrix grows with them.
MAX_LANGUAGES = 512
_WORD = re.compile(r"[^\W\d_]{1,4000}")


def _words(t: str):
    """Runs of letters, lower-cased; ``\\w`` has numbers besides (fractions, superscripts), which part words."""
    ws = _WORD.findall(t.lower())
    if "".join(ws).isalpha():
        return ws
    return ["".join(g) for w in ws for ok, g in itertools.groupby(w, str.isalpha) if ok]


class LangId:
    """``fit`` then ``transform``; ``languages`` and ``log_prob`` are the model."""

    def __init__(self, orders=ORDERS, bits: int = BITS, alpha: float = ALPHA):
        self.orders, self.bits, self.alpha = tuple(orders), bits, alpha
        self.languages: list[str] = []
        self.log_prob = np.zeros((1 << bits, 0), np.float32)
        self.prior = np.zeros(0)

    def fit(self, docs: DataFrame, text: str = "text", lang: str = "lang") -> "LangId":
        """Count over every row of ``docs`` that has a text and a language."""
        ship(docs.sparkSession)
        rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
        orders, bits = self.orders, self.bits

        def count(batches):
            schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
            vocab, seen = Vocab(), {}
            flush = lambda: _counted(vocab, seen, orders, bits, schema)
            for b in text_chunks(batches):
                langs = b.column(1).to_pylist()
                ids, off = doc_words(b.column(0).to_pylist(), _words, vocab)
                for name in set(langs):
                    mine = np.repeat(np.fromiter((x == name for x in langs), bool, len(langs)), np.diff(off))
                    docs_n, words_n = seen.get(name, (0, np.zeros(0, np.int64)))
                    add = np.bincount(ids[mine], minlength=len(vocab))
                    add[: len(words_n)] += words_n
                    seen[name] = (docs_n + langs.count(name), add)
                if vocab.full:
                    yield from flush()
                    vocab, seen = Vocab(), {}
            yield from flush()

        got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        table = got.toArrow()
        langs = np.array(table.column("lang").to_pylist(), object)
        bucket, n = table.column("bucket").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)
        names = sorted(set(langs.tolist()))
        if len(names) > MAX_LANGUAGES:
            raise ValueError(f"{len(names)} languages; the limit is {MAX_LANGUAGES}")
        self.languages = names
        if not names:
            return self
        place = {x: i for i, x in enumerate(names)}
        col = np.fromiter(map(place.__getitem__, langs), np.int64, len(langs))
        counts, docs_n = np.zeros((1 << self.bits, len(names))), np.zeros(len(names))
        own = bucket < 0
        docs_n[col[own]] = n[own]
        np.add.at(counts, (bucket[~own], col[~own]), n[~own])
        counts += self.alpha
        self.log_prob = np.log(counts / counts.sum(0)).astype(np.float32)
        self.prior = np.log((docs_n + 1) / (docs_n + 1).sum())
        return self

    def transform(self, docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
        """``keep`` columns, lang_pred, score (posterior of the predicted language)."""
        spark = docs.sparkSession
        ship(spark)
        model = spark.sparkContext.broadcast((self.languages, self.log_prob, self.prior))
        orders, bits = self.orders, self.bits
        src = docs.select(F.col(text).alias("__text"), *keep)
        fields = [src.schema[k] for k in keep]
        ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])

        def score(batches):
            names, log_prob, prior = model.value
            vocab, table, known = Vocab(), np.zeros((0, max(1, len(names))), np.float32), 0
            for b in text_chunks(batches, "__text"):
                texts = b.column(0).to_pylist()
                if names:
                    if vocab.full:
                        vocab, table, known = Vocab(), table[:0], 0
                    ids, off = doc_words(texts, _words, vocab)
                    fresh = [w.encode() for w in list(vocab)[known:]]
                    for part in slices(fresh):
                        flat, at = ngram_buckets(part, orders, bits)
                        table = np.concatenate([table, segment_sum(log_prob[flat], at).astype(np.float32)])
                    known = len(vocab)
                    s = segment_sum(table[ids], off) + prior
                    best = s.argmax(1)
                    top = s[np.arange(len(s)), best]
                    p = 1 / np.exp(s - top[:, None]).sum(1)
                    letter = np.diff(off) > 0
                    pred = [names[k] if ok else "und" for k, ok in zip(best.tolist(), letter)]
                    p = np.where(letter, np.clip(p, 0, 1), 0.0)
                else:
                    pred, p = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(pred, pa.string()), pa.array(p, pa.float64())], names=[*b.schema.names[1:], "lang_pred", "score"])

        return src.mapInArrow(score, ddl)


def _counted(vocab, seen, orders, bits, schema):
    if not seen:
        return
    sums = {name: np.zeros(1 << bits, np.int64) for name in seen}
    at = 0
    for part in slices([w.encode() for w in vocab]):  # bounded: the n-grams of a slice at a time
        flat, off = ngram_buckets(part, orders, bits)
        per = np.diff(off)
        for name, (_, words_n) in seen.items():
            mine = np.zeros(len(part), np.int64)
            have = words_n[at : at + len(part)]
            mine[: len(have)] = have
            if mine.any():
                sums[name] += np.bincount(flat, weights=np.repeat(mine, per), minlength=1 << bits).astype(np.int64)
        at += len(part)
    for name, (docs_n, _) in seen.items():
        hit = np.flatnonzero(sums[name])
        bucket, n = np.concatenate([[-1], hit]), np.concatenate([[docs_n], sums[name][hit]])
        yield out_batch(schema, [name] * len(n), bucket.astype(np.int32), n)

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text (x): the share of each distinct hashed word, one-hot bins of structure
statistics (marks, capitals, digits, repeated neighbours, distinct words, word and line
lengths, length in characters), and one-hot bins of metadata: the columns a caller names
(``n_chars``, the length that the table states; a null has a bin of its own). The score is
``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j`` through the logistic function; the
pairwise term is computed in linear time as
``1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``.

Fitted on the driver with Adam on a bounded sample of the labelled rows (``PER_CLASS`` of
each class, smallest by a hash of the id, texts of up to ``SAMPLE_CHARS`` characters), weighted
back to the classes' shares of all labelled rows; the model's size is fixed by ``BITS`` and
``RANK``. Scoring is one pass over whole texts.

Defined cases: null or empty texts have no word features and the lowest bins; rows without
label or text teach nothing; with no training rows, or one class alone, the score is a
constant; a document id with several labels counts once for each, rows that repeat an id and
label teach by the smallest of their texts and are scored each; equal hashes in the sample's
order go by id; very long texts are scored in whole; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import Vocab, doc_words, segment_sum
from .toxicity import labelled_sample, score_texts

BITS, RANK, BINS = 13, 4, 10
PER_CLASS, STEPS, RATE, L2 = 2000, 150, 0.05, 1e-3
_SPLIT = re.compile(r"[^ \t\n\r\f\v]+").findall
_MARK = re.compile(r"[^\w\s]")
#: Upper edges of the bins; the first bin is below the first edge.
EDGES = {
    "mark_heavy": [0.01, 0.03, 0.06, 0.1, 0.16, 0.25, 0.4, 0.6, 0.8],
    "mark_only": [0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8],
    "marked_end": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8],
    "upper": [0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8],
    "digit": [0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8],
    "same_as_before": [0.005, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8],
    "distinct": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "word_length": [2, 3, 4, 4.5, 5, 6, 7, 9, 14],
    "line_words": [2, 4, 8, 16, 32, 64, 128, 256, 1024],
    "characters": [16, 64, 150, 400, 1000, 2500, 6000, 15000, 40000],
}
STATS = list(EDGES)
#: Metadata columns there is room for; their bins are those of "characters", and one for null.
METADATA = 2
_FEATURES = (1 << BITS) + BINS * len(STATS) + (BINS + 1) * METADATA


def _word_facts(w: str):
    n = len(w)
    marks = len(_MARK.findall(w))
    letters = sum(c.isalpha() for c in w)
    return (
        marks >= 2,
        marks == n,
        n > 1 and not w[-1].isalnum() and w[-1] not in ".,;:",
        letters > 0 and w.upper() == w and w.lower() != w,
        any(c.isdigit() for c in w),
        n,
    )


def _bucket(w: bytes) -> int:
    h = 0xCBF29CE484222325
    for c in w:
        h = ((h ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 33)) * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - BITS)


class _Reader:
    """texts -> sparse feature rows (flat feature ids, values, offsets); tables of distinct words kept."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.vocab, self.known = Vocab(), 0
        self.facts, self.bucket = np.zeros((0, 6)), np.zeros(0, np.int64)

    def __call__(self, texts, metadata=None):
        if self.vocab.full:
            self.reset()
        ids, off = doc_words(texts, _SPLIT, self.vocab)
        fresh = list(self.vocab)[self.known :]
        if fresh:
            self.facts = np.concatenate([self.facts, np.array([_word_facts(w) for w in fresh], float)])
            self.bucket = np.concatenate([self.bucket, np.fromiter((_bucket(w.lower().encode("utf-8", "replace")) for w in fresh), np.int64, len(fresh))])
            self.known = len(self.vocab)
        rows = len(texts)
        n = np.diff(off)
        safe = np.maximum(1, n)
        f = segment_sum(self.facts[ids], off) / safe[:, None]
        row = np.repeat(np.arange(rows, dtype=np.int64), n)
        same = np.zeros(len(ids))
        same[1:] = (ids[1:] == ids[:-1]) & (row[1:] == row[:-1])
        repeat = segment_sum(same, off) / safe
        key = np.sort(row << BITS | self.bucket[ids])
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([new, [len(key)]]))
        krow, kfeat = key[new] >> BITS, key[new] & ((1 << BITS) - 1)
        distinct = np.bincount(krow, minlength=rows) / safe
        lines = np.array([(t or "").count("\n") + 1 for t in texts], float)
        chars = np.array([len(t or "") for t in texts], float)
        stats = np.stack([f[:, 0], f[:, 1], f[:, 2], f[:, 3], f[:, 4], repeat, distinct, f[:, 5], n / lines, chars], 1)
        bins = np.stack([np.searchsorted(EDGES[s], stats[:, k], side="right") for k, s in enumerate(STATS)], 1)
        sfeat = (1 << BITS) + np.arange(len(STATS)) * BINS + bins
        if metadata is not None and metadata.shape[1]:
            at = np.where(np.isnan(metadata), BINS, np.searchsorted(EDGES["characters"], np.nan_to_num(metadata), side="right"))
            sfeat = np.concatenate([sfeat, (1 << BITS) + BINS * len(STATS) + np.arange(metadata.shape[1]) * (BINS + 1) + at], 1)
        return (np.concatenate([krow, np.repeat(np.arange(rows), sfeat.shape[1])]), np.concatenate([kfeat, sfeat.ravel()]), np.concatenate([count / safe[krow], np.ones(sfeat.size)]), rows)


def _logits(row, feat, x, rows, w0, w, v):
    """Linear-time scores, and the sums the gradient needs."""
    y = w0 + np.bincount(row, weights=w[feat] * x, minlength=rows)
    sums = []
    for k in range(v.shape[1]):
        vx = v[feat, k] * x
        s = np.bincount(row, weights=vx, minlength=rows)
        y += 0.5 * (s * s - np.bincount(row, weights=vx * vx, minlength=rows))
        sums.append(s)
    return y, sums


class Quality:
    def __init__(self, seed: int = 3, metadata: tuple = ()):
        if len(metadata) > METADATA:
            raise ValueError(f"{len(metadata)} metadata columns; the limit is {METADATA}")
        self.seed, self.metadata = seed, tuple(metadata)

    def fit_rows(self, texts: list[str], labels, weights=None, metadata=None) -> "Quality":
        y = np.asarray(labels, float)
        rng = np.random.default_rng(self.seed)
        self.w0, self.w, self.v = 0.0, np.zeros(_FEATURES), np.zeros((_FEATURES, RANK))
        if not len(y) or y.min() == y.max():
            self.w0 = 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)
            return self
        weight = np.ones(len(y)) if weights is None else np.asarray(weights, float)
        weight = weight / weight.sum()
        row, feat, x, rows = _Reader()(texts, metadata)
        v, w, w0 = rng.normal(0, 0.05, (_FEATURES, RANK)), self.w, np.zeros(1)
        used = np.unique(feat)
        seen = np.zeros(_FEATURES, bool)
        seen[used] = True
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w0, w, v)]
        for step in range(STEPS):
            s, sums = _logits(row, feat, x, rows, w0[0], w, v)
            p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
            g = (p - y) * weight
            gx = g[row] * x
            g_w = np.bincount(feat, weights=gx, minlength=_FEATURES) + L2 * w / 10
            g_v = np.zeros_like(v)
            for k in range(RANK):
                g_v[:, k] = np.bincount(feat, weights=gx * (sums[k][row] - v[feat, k] * x), minlength=_FEATURES)
            g_v += L2 * v / 10
            for k, (param, grad) in enumerate(((w0, np.array([g.sum()])), (w, g_w), (v, g_v))):
                m, q = state[k]
                m *= 0.9
                m += 0.1 * grad
                q *= 0.99
                q += 0.01 * grad * grad
                param -= RATE * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(q / (1 - 0.99 ** (step + 1))) + 1e-8)
        v[~seen] = 0
        w[~seen] = 0
        self.w0, self.w, self.v = float(w0[0]), w, v
        return self

    def fit(self, docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> "Quality":
        return self.fit_rows(*labelled_sample(docs, labels, text, label, per_class, self.metadata))

    def scorer(self):
        reader = _Reader()

        def score(texts, metadata=None) -> np.ndarray:
            row, feat, x, rows = reader(texts, metadata)
            s, _ = _logits(row, feat, x, rows, self.w0, self.w, self.v)
            return 1 / (1 + np.exp(-np.clip(s, -40, 40)))

        return score

    def transform(self, docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
        """``keep`` columns and score."""
        return score_texts(docs, self, text, keep, self.metadata)

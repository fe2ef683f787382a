"""Shared plumbing of the training-data operators.

* :class:`tripleloom.scratch.Scratch` cuts lineage with Parquet tables in the shared
  folder that the cluster names in ``spark.checkpoint.dir`` (an executor that is lost
  costs a re-read, never a recomputation of the whole job).
* :func:`text_chunks` bounds what one Python worker holds: a record batch is cut
  into pieces of a few MB of text, whatever the row count.
* :class:`Vocab` numbers the distinct words of a task, so that per-word work
  (hashing, n-grams, merges) is done once per distinct word, vectorised.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..scratch import Scratch

CHUNK_BYTES = 4 << 20
#: Distinct words, and characters in them, that a task keeps before it starts a new table.
VOCAB_LIMIT, VOCAB_CHARS = 400_000, 16 << 20
#: Bytes of words whose n-grams are made at once.
SLICE_BYTES = 256 << 10


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (once a session), so that workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tripleloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="tripleloom-"), "tripleloom_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(os.path.join(root, "tripleloom")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._tripleloom_shipped = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Record batches cut so that ``column`` holds about ``limit`` bytes (one row at least)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(at, to - at)
            at = to


class Vocab(dict):
    """word -> id, numbered in order of first sight."""

    chars = 0

    def __missing__(self, w):
        i = self[w] = len(self)
        self.chars += len(w)
        return i

    @property
    def full(self) -> bool:
        return len(self) > VOCAB_LIMIT or self.chars > VOCAB_CHARS

    def ids(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def slices(words: list[bytes], limit: int = SLICE_BYTES):
    """``words`` in lists of about ``limit`` bytes (one word at least)."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield words[at:to]
        at = to


def doc_words(texts, split, vocab: Vocab):
    """(flat word ids, offsets): words of each text by ``split``; null counts as empty."""
    parts, off = [], np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        ws = split(t) if t else ()
        off[i + 1] = off[i] + len(ws)
        if ws:
            parts.append(vocab.ids(ws))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), off


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated ranges [start, start+length)."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]] (0 for empty segments), along axis 0."""
    out = np.zeros((len(off) - 1,) + values.shape[1:], np.float64)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full], axis=0)
    return out


def ngram_buckets(words: list[bytes], orders, bits: int, whole: bool = False):
    """Hashed byte n-grams of padded words (`` word ``): (flat buckets, offsets by word).

    ``whole`` adds one bucket for the whole padded word.
    """
    n = len(words)
    padded = [b" " + w + b" " for w in words]
    buf = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64)
    ln = np.fromiter(map(len, padded), np.int64, n)
    off = np.concatenate([[0], np.cumsum(ln)])
    owner = np.repeat(np.arange(n, dtype=np.int64), ln)
    pos = np.arange(len(buf), dtype=np.int64)
    left = off[1:][owner] - pos if n else np.zeros(0, np.int64)  # bytes from here to the word's end
    ids, own = [], []
    h = np.zeros(len(buf), np.uint64)
    prime, golden, shift = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    for k in range(1, min(max(orders), len(buf)) + 1):
        h = h * prime
        h[: len(buf) - k + 1] += buf[k - 1 :] + np.uint64(1)
        if k in orders:
            ok = left >= k
            x = h[ok] + np.uint64(k * 0x51ED27)
            x ^= x >> np.uint64(29)
            ids.append(((x * golden) >> shift).astype(np.int64))
            own.append(owner[ok])
    if whole and n:
        x = np.add.reduceat(buf * (pos.astype(np.uint64) - off[:-1][owner].astype(np.uint64) + np.uint64(1)) * prime + (buf + np.uint64(7)) ** np.uint64(5), off[:-1])
        x ^= x >> np.uint64(31)
        ids.append(((x * golden) >> shift).astype(np.int64))
        own.append(np.arange(n, dtype=np.int64))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    flat, owners = np.concatenate(ids), np.concatenate(own)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=n)
    return flat[order], np.concatenate([[0], np.cumsum(counts)])


def out_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=False) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def tables_dir_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

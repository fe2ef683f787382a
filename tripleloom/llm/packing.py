"""Packing documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

1. Tokenize every whole text (one end id after each document), once per distinct
   whitespace-delimited word of a task, and cut it into pieces of at most ``length`` ids.
2. A piece of the full length is a sequence by itself. The others are dealt by a seeded
   hash of (document, start) into randomised groups of about ``GROUP`` pieces, however
   hot a source is, and each group is packed on its own: pieces in descending length,
   each into the first bin that still has room, found by descending a max tree over the
   bins' free capacity (log of the bins a piece, no scan).
3. The bins left at the end of a group are the only loosely filled ones; with groups of
   thousands of pieces they are a few in a thousand sequences.

Defined cases: a null or empty text has the end id alone, one piece of length 1; repeated
document ids, null ones too, are separate documents; very long texts are cut into pieces like
others; pieces of equal length go in the order of
(hash, document id, start); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK_BYTES, VOCAB_LIMIT, Scratch, ragged, ship, text_chunks

LENGTH, END_ID, GROUP, SEED = 2048, 1, 16384, 17
#: Letters whose lower case, normal form and class are beyond doubt, and a run of closing marks: the tokenizer cuts between the two.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_STEM = re.compile(rf"([{_LETTERS}]+)([.,;:!?#$%&*|)]*)").fullmatch


class WordIds:
    """word -> its token ids; the tokenizers library encodes a word the first time a worker sees it.

    A word of plain letters is one pre-token, and goes to the library's merge model at once,
    in lower case and in the byte alphabet of its pre-tokenizer; all else takes the whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x61, 0x180)}
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, w: str) -> bytes:
        return array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes()

    def word(self, w: str) -> bytes:
        """Token ids of a word without ASCII white space, as little-endian bytes."""
        m = _STEM(w)
        if not m:
            return self._whole(w)
        stem, marks = m.groups()
        stem = stem.lower()
        got = self.known.get(stem)
        if got is None:
            ids = [t.id for t in self.model.tokenize(stem if stem.isascii() else stem.translate(self.alphabet))]
            got = array("I", ids).tobytes()
            if len(self.known) < VOCAB_LIMIT:  # early words are the frequent ones; later ones are encoded again
                self.known[stem] = got
        if marks:
            if marks not in self.marks and len(self.marks) < VOCAB_LIMIT:
                self.marks[marks] = self._whole(marks)
            got += self.marks.get(marks) or self._whole(marks)
        return got

    def streams(self, texts: pa.Array):
        """(ids of all texts in one array, offsets): each distinct word of the array is looked up once."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        which = coded.indices.to_numpy()
        raw = [self.word(w) if w else b"" for w in coded.dictionary.to_pylist()]
        n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids = np.frombuffer(b"".join(raw), "<u4")
        start = np.cumsum(n) - n
        size = n[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids[ragged(start[which], size)], ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


_workers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The word table of this worker process; what a word encodes to never changes."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids where ``with_ids``): the pieces of every document."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("__text"))
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches):
        words = word_ids(tokenizer)
        for b in text_chunks(batches, "__text", 2 * CHUNK_BYTES):
            gc.disable()  # the word table has no cycles, and scanning it again and again costs more than all merges
            try:
                stream, ends = words.streams(b.column("__text"))
                docs_, start, size, crc, total, all_ids = [], [], [], [], [], []
                for i, doc in enumerate(b.column("doc_id").to_pylist()):
                    mine = np.append(stream[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    n = len(mine)
                    for s in range(0, n, length):
                        part = mine[s : s + length]
                        docs_.append(doc)
                        start.append(s)
                        size.append(len(part))
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        if with_ids:
                            all_ids.append(part.astype(np.int32))
            finally:
                gc.enable()
            cols = [pa.array(x, pa.int64()) for x in (docs_, start, size, crc, total)] + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return src.mapInArrow(run, ddl)


class Tournament:
    """First bin with at least a given room: a max tree over bin capacities."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset-free room before) of the first bin with room; takes the room."""
        tree, k = self.tree, 1
        if tree[1] < size:
            raise ValueError("no bin has room")
        while k < self.leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        room = tree[k]
        leaf = k - self.leaves
        tree[k] = room - size
        k //= 2
        while k:
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
            k //= 2
        return leaf, room


def first_fit_decreasing(sizes, capacity: int = LENGTH):
    """(bin, offset) of each size, given in descending order."""
    sizes = [int(x) for x in sizes]
    n = len(sizes)
    tree = Tournament(n, capacity)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, s in enumerate(sizes):
        leaf, room = tree.place(s)
        bins[i], offsets[i] = leaf, capacity - room
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` needs doc_id, start and length."""
    spark = pieces.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "packing")
    pieces = scratch.table(pieces, "pieces")
    loose = F.col("length") < length
    n = pieces.where(loose).count()
    groups = max(1, -(-n // group))
    h = F.xxhash64(F.col("doc_id"), F.col("start"), F.monotonically_increasing_id(), F.lit(seed))
    dealt = pieces.withColumn("__h", h)
    whole = (
        dealt.where(~loose)
        .withColumn("sequence_id", F.shiftleft(F.lit(1).cast("long"), 62) + F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("__h")
    )
    fields = pieces.schema.fields
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["sequence_id long", "offset long"])
    names = [f.name for f in fields]

    def fit(key, table):
        order = pc.sort_indices(table, sort_keys=[("length", "descending"), ("__h", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        table = table.take(order)
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), length)
        return pa.table([*[table.column(c) for c in names], pa.array(bins + (key[0].as_py() << 24), pa.int64()), pa.array(offsets, pa.int64())], names=[*names, "sequence_id", "offset"])

    packed = dealt.where(loose).withColumn("__g", F.pmod(F.xxhash64("__h"), F.lit(groups))).groupBy("__g").applyInArrow(fit, ddl)
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, **options) -> DataFrame:
    """Tokenize, cut and pack every document: one row a piece."""
    return pack(token_pieces(docs, tokenizer, length), length, **options)

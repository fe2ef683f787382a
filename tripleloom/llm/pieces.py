"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text is normalised as the model says (identity normaliser, dummy prefix, spaces to
U+2581) and cut before each U+2581 that follows another character: no piece of the
vocabulary spans such a place (checked when the model is loaded), so merges never do.
The distinct words of a task are merged together in flat numpy arrays. One round:

1. rank of every adjacent pair (a sorted table of pair keys, binary search);
2. minimum rank of each word by a segmented reduction;
3. in each word, merge the leftmost occurrences of its minimum at once; in a run of
   overlapping ones every second. The library pops one pair at a time, so where a
   merge creates a pair of a still lower rank, the merges right of it wait a round;
4. compact the arrays; words without a mergeable pair leave.

Characters outside the vocabulary become byte pieces. Decoding joins pieces, undoes the
prefix and decodes bytes, again once per distinct word.

Defined cases: null counts as empty; an empty text has the end id alone and decodes to
the empty string; very long texts and words are encoded in whole (a word's arrays grow with
it); pairs of equal rank merge from the left, as the library does; repeated rows, null ids
among them, give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Vocab, doc_words, ragged, ship, text_chunks

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NEVER = np.int64(1 << 40)


class Pieces:
    """Vocabulary of a SentencePiece BPE model with byte fallback and identity normaliser."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.names = names
        self.byte = np.full(256, -1, np.int64)
        normal = []
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        if (self.byte < 0).any():
            raise ValueError("the model has no byte fallback")
        if any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in normal):
            raise ValueError("a piece spans words")
        score = {i: sp.get_score(i) for i in normal}
        level = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        ids = {names[i]: i for i in normal}
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        keys, rank, to = [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    rank.append(level[score[i]])
                    to.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.rank = np.array(rank, np.int64)[order]
        self.to = np.array(to, np.int64)[order]
        self.n = n
        self.surface = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]

    def _pairs(self, a: np.ndarray, b: np.ndarray):
        """(rank, merged id) of pairs; rank NEVER where there is none. Unknown symbols are negative."""
        key = np.where((a < 0) | (b < 0), -1, a * self.n + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NEVER), self.to[at]

    def encode_words(self, words: list[str]):
        """(flat ids, offsets) of words, each as if alone."""
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.of_char[code]
        sym = np.where(sym < 0, -1 - code, sym)
        own = np.repeat(np.arange(n, dtype=np.int64), lens)
        rank, to = self._ranks(sym, own, np.arange(len(sym)))
        done_sym, done_own = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            low = np.minimum.reduceat(rank, first)
            per = np.diff(np.concatenate([first, [len(sym)]]))
            live = low < NEVER
            if not live.all():
                keep = np.repeat(live, per)
                done_sym.append(sym[~keep])
                done_own.append(own[~keep])
                sym, own, rank, to = sym[keep], own[keep], rank[keep], to[keep]
                low, per = low[live], per[live]
                if not len(sym):
                    break
            low = np.repeat(low, per)
            at = np.flatnonzero(rank == low)
            # of a run of overlapping occurrences, every second from its start
            fresh = np.ones(len(at), bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            if not fresh.all():
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            merged = self._merge(sym, own, rank, to, at)
            new_low = low[at]
            danger = np.minimum(merged[2][merged[4]], np.where(merged[4] > 0, merged[2][merged[4] - 1], NEVER) if len(at) else NEVER) < new_low
            if danger.any():
                # a merge made a lower-ranked pair, which goes before those right of it: one merge in such words
                hit = np.isin(own[at], own[at[danger]])
                opening = np.concatenate([[True], own[at][1:] != own[at][:-1]])
                merged = self._merge(sym, own, rank, to, at[~hit | opening])
            sym, own, rank, to, _ = merged
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        own = np.concatenate(done_own) if done_own else np.zeros(0, np.int64)
        order = np.argsort(own, kind="stable")
        sym, own = sym[order], own[order]
        odd = np.flatnonzero(sym < 0)
        if len(odd):  # byte fallback
            reps = np.ones(len(sym), np.int64)
            spelled = [chr(-1 - c).encode("utf-8", "replace") for c in sym[odd].tolist()]
            reps[odd] = [len(x) for x in spelled]
            own = np.repeat(own, reps)
            out = np.repeat(sym, reps)
            out[out < 0] = self.byte[np.frombuffer(b"".join(spelled), np.uint8)]
            sym = out
        return sym, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])

    def _ranks(self, sym, own, at):
        """(rank, merged id) of the pairs that begin at ``at``."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        rank, to = self._pairs(sym[at], sym[nxt])
        rank[(nxt == at) | (own[at] != own[nxt])] = NEVER
        return rank, to

    def _merge(self, sym, own, rank, to, at):
        """The arrays after merging the pairs at ``at`` (no two overlap), and the new symbols' places."""
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        out = sym.copy()
        out[at] = to[at]
        out, own, rank, to = out[keep], own[keep], rank[keep], to[keep]
        place = at - np.arange(len(at))
        stale = np.unique(np.concatenate([place, place[place > 0] - 1]))
        rank[stale], to[stale] = self._ranks(out, own, stale)
        return out, own, rank, to, place

    @staticmethod
    def words(text: str) -> list[str]:
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text with the end id."""
        ids, _ = self.encode_words(self.words(text or ""))
        return [*ids.tolist(), self.eos]

    def decode(self, ids) -> str:
        """Text of ids: spaces restored, the dummy prefix removed, invalid bytes replaced."""
        raw = b"".join([self.surface[i] for i in ids])
        return undo(raw)


def undo(raw: bytes) -> str:
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", keep: tuple = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded where ``with_ids``) of every text."""
    ship(docs.sparkSession)
    src = docs.select(F.col(text).alias("__text"), *keep)
    fields = [src.schema[k] for k in keep]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>", "decoded string"] * with_ids)

    def run(batches):
        model = Pieces(model_file)
        number = [str(i).encode() for i in range(model.n)]
        end = number[model.eos]
        vocab, known = Vocab(), 0
        flat, off, spelled, surface = [], [0], [], []  # by distinct word
        for b in text_chunks(batches, "__text"):
            texts = b.column(0).to_pylist()
            if vocab.full:
                vocab, known, flat, spelled, surface = Vocab(), 0, [], [], []
            ids, at = doc_words(texts, Pieces.words, vocab)
            fresh = list(vocab)[known:]
            if fresh:
                sym, o = model.encode_words(fresh)
                syms, o = sym.tolist(), o.tolist()
                for i in range(len(fresh)):
                    mine = syms[o[i] : o[i + 1]]
                    flat.append(mine)
                    spelled.append(b" ".join([number[k] for k in mine]))
                    surface.append(b"".join([model.surface[k] for k in mine]))
                known = len(vocab)
            ids, at = ids.tolist(), at.tolist()
            n, a, c, all_ids, decoded = [], [], [], [], []
            for i in range(len(texts)):
                mine = ids[at[i] : at[i + 1]]
                n.append(sum([len(flat[k]) for k in mine]) + 1)
                a.append(hashlib.sha256(b" ".join([*[spelled[k] for k in mine], end])).hexdigest())
                out = undo(b"".join([surface[k] for k in mine]))
                c.append(hashlib.sha256(out.encode()).hexdigest())
                if with_ids:
                    all_ids.append([x for k in mine for x in flat[k]] + [model.eos])
                    decoded.append(out)
            more = [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string()), *more], names=[*b.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids])

    return src.mapInArrow(run, ddl)

"""Exact substring deduplication with suffix arrays built by linear grouping.

A byte goes when a ``WINDOW``-byte string that covers it starts anywhere else too. What is
gathered are the windows that occur once; a document loses what its other windows cover.
So copies cost nothing beyond the first fold, however many there are.

1. *Anchors.* Every window has one: its leftmost smallest hashed ``GRAM``-byte gram. Equal
   windows have equal anchors at equal offsets, so only occurrences of the same anchor
   have to be compared. Neighbouring windows share anchors; a row is an anchor with the
   windows that chose it, its region (about 1.5 rows per 100 bytes).
2. *Fold.* Equal regions become one row with their number, by an aggregation with map-side
   sums. A region of an anchor that has no other is settled by that number.
3. *Suffix groups.* The different regions of an anchor are cut into cells of ``CELL``
   bytes aligned to the anchor; a suffix array over the cells of a block of anchors is
   built by :func:`suffix_array`, and suffixes that share the cells any window must have
   are neighbours in it. Among such neighbours the windows themselves are compared.
4. *Hot anchors.* An anchor with over ``BLOCK`` different regions (a passage of many documents, each
   time in other surroundings) is dealt anew by the bytes that windows at like offsets
   from it share, first ``SPLITS[0]`` offsets together, then one; equal parts fold again,
   and what is left in a group goes to the suffix arrays as in 3. With one offset, a group
   is one window, which the fold has counted. So no task gets more than ``BLOCK`` regions.

Digests are 64 bits of a polynomial over random byte codes, mixed; regions fold by 128.

Defined cases: null counts as empty; texts below ``WINDOW`` bytes lose nothing; rows that
are repeated whole, id included, count as separate documents (rows have numbers of their
own), null ids too; an empty table gives no rows; texts of any length are worked through
in segments; extra columns are ignored; there are no ties.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, ragged, ship, text_chunks
from .minhash import mix

WINDOW, GRAM, CELL, BLOCK = 200, 64, 16, 512
#: Offsets of a hot anchor's windows that are dealt together, at the first splitting and the last.
SPLITS = (16, 1)
SEGMENT = 1 << 20
#: Bytes of regions that one suffix array covers (more only if one anchor has more).
ARRAY_BYTES = 1 << 16

_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_pw = np.ones(1, np.uint64)
_ipw = np.ones(1, np.uint64)


def _powers(n: int):
    global _pw, _ipw
    if len(_pw) < n:
        size = max(n, 1 << 16)
        _pw = np.full(size, _BASE, np.uint64)
        _ipw = np.full(size, _INVERSE, np.uint64)
        _pw[0] = _ipw[0] = 1
        _pw, _ipw = np.multiply.accumulate(_pw), np.multiply.accumulate(_ipw)
    return _pw, _ipw


class Rolling:
    """Digests of substrings of a byte array; equal bytes have equal digests wherever they stand."""

    def __init__(self, buf: np.ndarray):
        pw, self.ipw = _powers(len(buf) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[buf] * pw[: len(buf)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.ipw[start])


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(first window, windows, anchor, anchor digest, region digest) over pieces [start, end) of ``buf``."""
    wide = WINDOW - GRAM + 1
    first, last = starts, ends - WINDOW + 1
    ok = last > first
    first, last = first[ok], last[ok]
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    roll = Rolling(buf)
    grams = np.arange(len(buf) - GRAM + 1)
    code = roll(grams, grams + GRAM)
    low = np.uint64((1 << 24) - 1)
    best = (code & ~low) | grams.astype(np.uint64)
    span = 1
    while span * 2 <= wide:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    if span < wide:
        best = np.minimum(best[: len(best) - (wide - span)], best[wide - span :])
    p = ragged(first, last - first)
    at = (best[p] & low).astype(np.int64)
    piece = np.repeat(np.arange(len(first)), last - first)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
    m = np.diff(np.concatenate([new, [len(p)]]))
    p0, a = p[new], at[new]
    region = mix(roll(p0, p0 + m + WINDOW - 1) ^ ((a - p0) << 32 | m).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return p0, m, a, code[a], region


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of ``s``, whose last symbol is its unique smallest, in linear grouping steps.

    First the suffixes are grouped by Lyndon prefix. Groups start as the sets of equal first
    symbols and are named by their first rank. In descending order, each member of a group
    points to the nearest earlier suffix of a smaller group; the suffixes pointed to move,
    those with more pointers higher, to new groups right above their old ones. Then the
    order inside groups follows, smallest suffix first: each emitted suffix puts the one
    before it, and the chain of pointers from there, at the front of their groups.
    """
    n = len(s)
    array = np.asarray(s, np.int64)
    order = np.argsort(array, kind="stable")
    ordered = array[order]
    edges = [0, *(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1).tolist(), n]
    order = order.tolist()
    group, members, end_of, start_at = [0] * n, {}, {}, {}
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        mine = order[a:b]
        members[a], end_of[a], start_at[b] = mine, b, a
        for i in mine:
            group[i] = a
    before = [-1] * n
    top = n
    while top > 0:
        start = start_at[top]
        # in order of place: the first sort is stable, and pointers of places in order are in order
        mine = [i for i in members.pop(start) if group[i] == start]
        pointed: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        members[start] = mine
        if pointed:
            moves: list[dict[int, list[int]]] = [{} for _ in range(max(pointed.values()) + 1)]
            for j, c in pointed.items():
                moves[c].setdefault(group[j], []).append(j)
            for part in reversed(moves):  # those with more pointers first, so higher
                for g, up in part.items():
                    end = end_of[g]
                    new = end - len(up)
                    if new == g:
                        continue
                    for j in up:
                        group[j] = new
                    members[new], end_of[new], start_at[end] = up, end, new
                    end_of[g], start_at[new] = new, g
        top = start
    out, front, placed = [0] * n, {}, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = front.get(g, g)
            out[at] = j
            front[g] = at + 1
            placed[j] = True
            j = before[j]
    return out


def repeated_windows(regions: list[bytes], left: np.ndarray):
    """(region, window start) pairs of windows that occur in ``regions`` more than once.

    ``left`` is the anchor's place in each region; a region's windows are all that fit in it.
    """
    size = np.fromiter(map(len, regions), np.int64, len(regions))
    base = np.concatenate([[0], np.cumsum(size)])
    buf = np.frombuffer(b"".join(regions), np.uint8)
    roll = Rolling(buf)
    first = left % CELL
    cells = (size - first) // CELL
    cell_at = ragged(np.zeros(len(regions), np.int64), cells) * CELL + np.repeat(base[:-1] + first, cells)
    owner = np.repeat(np.arange(len(regions)), cells)
    names, rank = np.unique(roll(cell_at, cell_at + CELL), return_inverse=True)
    # sequence: the cells of each region, then a separator of its own, then the end
    place = np.arange(len(cell_at)) + owner
    total = len(cell_at) + len(regions) + 1
    seq = np.zeros(total, np.int64)
    seq[place] = rank + len(regions) + 1
    seq[np.cumsum(cells + 1) - 1] = np.arange(1, len(regions) + 1)
    need = (WINDOW - CELL + 1) // CELL
    order = np.array(suffix_array(seq.tolist()), np.int64)
    cell_of = np.full(total, -1, np.int64)
    cell_of[place] = np.arange(len(cell_at))
    c = cell_of[order]
    c = c[c >= 0]
    last = np.concatenate([[0], np.cumsum(cells)])[1:][owner] if len(owner) else owner
    long = c + need <= last[c]
    start = cell_at[c]
    shared = np.where(long, roll(start, np.minimum(start + need * CELL, len(buf))), np.uint64(0))
    same = (shared[1:] == shared[:-1]) & long[1:] & long[:-1]
    cluster = np.concatenate([[0], np.cumsum(~same)]) if len(c) else np.zeros(0, np.int64)
    crowd = np.bincount(cluster)[cluster] > 1 if len(c) else np.zeros(0, bool)
    c, cluster = c[crowd], cluster[crowd]
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r = owner[c]
    p = (cell_at[c][:, None] - np.arange(CELL)[None, :]).ravel()
    r, cluster = np.repeat(r, CELL), np.repeat(cluster, CELL)
    fits = (p >= base[r]) & (p + WINDOW <= base[r + 1])
    p, r, cluster = p[fits], r[fits], cluster[fits]
    code = mix(roll(p, p + WINDOW) + cluster.astype(np.uint64))
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    return r[hit], p[hit] - base[r[hit]]


def _runs(r: np.ndarray, p: np.ndarray):
    """(r, first p, length) of runs of consecutive p."""
    order = np.lexsort([p, r])
    r, p = r[order], p[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)])) if len(r) else np.zeros(0, np.int64)
    return r[new], p[new], np.diff(np.concatenate([new, [len(r)]]))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """anchor, region, d and q, which packs the first window, the number of windows and the anchor's place."""

    def run(batches):
        for b in text_chunks(batches, "body", SEGMENT):
            d, bodies = b.column("d").to_numpy(), b.column("body").to_pylist()
            # segments overlap by WINDOW - 1 bytes, so that each window lies in one
            parts = [(i, s, body[s : s + SEGMENT + WINDOW - 1]) for i, body in enumerate(bodies) if body for s in range(0, max(1, len(body) - WINDOW + 1), SEGMENT)]
            at = 0
            while at < len(parts):
                to, n = at, 0
                while to < len(parts) and (to == at or n + len(parts[to][2]) <= 2 * SEGMENT):
                    n += len(parts[to][2])
                    to += 1
                mine = parts[at:to]
                at = to
                size = np.array([len(x[2]) for x in mine], np.int64)
                ends = np.cumsum(size)
                p0, m, a, code, region = anchors(np.frombuffer(b"".join([x[2] for x in mine]), np.uint8), ends - size, ends)
                piece = np.searchsorted(ends, p0, side="right")
                shift = np.array([x[1] for x in mine], np.int64) - (ends - size)
                who = d[np.array([x[0] for x in mine], np.int64)]
                q = (p0 + shift[piece]) << 16 | m << 8 | (a - p0)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(region.view(np.int64)), pa.array(who[piece]), pa.array(q)], names=["anchor", "region", "d", "q"])

    return docs.select("d", "body").mapInArrow(run, "anchor long, region long, d long, q long")


def _cut(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``items`` (key, d, q, c, k) as regions: key, k, d, first window, place of the anchor, number of occurrences, bytes."""
    by = items.groupBy("d").agg(F.collect_list(F.struct("key", "q", "c", "k")).alias("items"))
    both = by.join(docs.select("d", "body"), "d")

    def run(batches):
        for b in text_chunks(batches, "body", SEGMENT):
            for d, body, items in zip(b.column("d").to_pylist(), b.column("body").to_pylist(), b.column("items")):
                flat = items.values
                q = flat.field("q").to_numpy()
                p, m, left = q >> 16, q >> 8 & 255, q & 255
                cut = pa.array([body[x : x + y + WINDOW - 1] for x, y in zip(p.tolist(), m.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("k"), pa.array(np.full(len(p), d, np.int64)), pa.array(p), pa.array(left.astype(np.int16)), flat.field("c"), cut], names=["key", "k", "d", "p", "left", "c", "bytes"])

    return both.select("d", "body", "items").mapInArrow(run, _REGION)


_REGION = "key long, k long, d long, p long, left short, c long, bytes binary"


def _grouped(rows: DataFrame) -> DataFrame:
    """(d, p, m) of the windows that occur once among the regions of their key, by suffix arrays."""
    dealt = rows.repartition("key").sortWithinPartitions("key")

    def solve(held):
        d, p, left, c = (np.concatenate([t.column(x).to_numpy() for t in held]) for x in ("d", "p", "left", "c"))
        regions = [x for t in held for x in t.column("bytes").to_pylist()]
        r, w = repeated_windows(regions, left.astype(np.int64))
        m = np.fromiter(map(len, regions), np.int64, len(regions)) - WINDOW + 1
        base = np.cumsum(m) - m
        once = np.repeat(c == 1, m)
        once[base[r] + w] = False
        at = np.flatnonzero(once)
        r = np.searchsorted(base, at, side="right") - 1
        r, w, m = _runs(r, at - base[r])
        return pa.RecordBatch.from_arrays([pa.array(d[r]), pa.array(p[r] + w), pa.array(m.astype(np.int32))], names=["d", "p", "m"])

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            a = b.column("key").to_numpy()
            if not len(a):
                continue
            edge = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(b.column("bytes")).to_numpy())])
            for at, to in zip(edge, edge[1:]):
                if size >= ARRAY_BYTES and a[at] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(b.slice(at, to - at))
                size += int(sizes[to] - sizes[at])
                last = a[at]
        if held:
            yield solve(held)

    return dealt.mapInArrow(run, _ONCE)


_ONCE = "d long, p long, m int"


def split(key: int, left: int, region: bytes, step: int):
    """Parts of a region whose windows lie at like offsets from its anchor: (key, digest, first window, anchor's place, bytes).

    Windows at offsets [step * k, step * (k + 1)) all hold the bytes from step * k before the anchor on, up to the end
    of the earliest of them; a part's key stands for the old key, k and those bytes.
    """
    m = len(region) - WINDOW + 1
    offset = left - np.arange(m)
    first = np.flatnonzero(np.concatenate([[True], offset[1:] // step != offset[:-1] // step]))
    last = np.concatenate([first[1:], [m]])
    k = offset[first] // step
    roll = Rolling(np.frombuffer(region, np.uint8))
    held = roll(left - step * k, left - step * k - step + 1 + WINDOW)
    keys = mix(held ^ mix(np.full(len(k), np.uint64(key & 0xFFFFFFFFFFFFFFFF)) + (k * 1024 + step).astype(np.uint64)))
    codes = mix(roll(first, last + WINDOW - 1) + mix(((left - first) * 1024 + last - first).astype(np.uint64)))
    return keys.view(np.int64), codes.view(np.int64), first, left - first, [region[a : b + WINDOW - 1] for a, b in zip(first.tolist(), last.tolist())]


def _split(rows: DataFrame, step: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                if not part.num_rows:
                    continue
                got = [split(*x, step) for x in zip(part.column("key").to_pylist(), part.column("left").to_pylist(), part.column("bytes").to_pylist())]
                n = np.array([len(g[0]) for g in got])
                wide = lambda c: np.repeat(part.column(c).to_numpy(), n)
                key, code, first, left = (np.concatenate([g[k] for g in got]) for k in range(4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(code), pa.array(wide("d")), pa.array(wide("p") + first), pa.array(left.astype(np.int16)), pa.array(wide("c")), pa.array([x for g in got for x in g[4]], pa.binary())],
                    names=["key", "code", "d", "p", "left", "c", "bytes"],
                )

    return rows.mapInArrow(run, "key long, code long, d long, p long, left short, c long, bytes binary")


def keyed(docs: DataFrame, text: str, keep: tuple) -> DataFrame:
    """``keep`` columns, d (a number of the row) and body (UTF-8 bytes); to be written, so that the number stays."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(*keep, F.monotonically_increasing_id().alias("d"), body.alias("body"))


def _sorted_out(regions: DataFrame, scratch: Scratch, tag: str):
    """``regions`` (key, c, ...) by key: (those settled by the fold: once and alone, those to compare with their number k)."""
    one = [F.first(x).alias(x) for x in ("d", "q")]
    by = regions.groupBy("key").agg(F.count("*").alias("k"), F.min("c").alias("least"), *one)
    by = scratch.table(by.where("least = 1"), f"{tag}-keys")
    alone = by.where("k = 1").select("d", (F.shiftright("q", 16)).alias("p"), F.expr("cast(shiftright(q, 8) & 255 as int)").alias("m"))
    return alone, regions.join(by.where("k > 1").select("key", "k"), "key")


def single_windows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, p, m): window starts [p, p + m) of texts (d, body) that start nowhere else."""
    found = _anchor_rows(rows).groupBy(F.col("anchor").alias("key"), "region").agg(F.count("*").alias("c"), F.first("d").alias("d"), F.first("q").alias("q"))
    found = scratch.table(found.select("key", "c", "d", "q"), "regions")
    alone, mixed = _sorted_out(found, scratch, "regions")
    out = alone
    # written: what is hot and what is not read the same rows
    items = scratch.table(_cut(mixed.select("key", "d", "q", "c", "k"), rows), "cut")
    scratch.drop("regions")
    out = out.unionByName(_grouped(items.where(F.col("k") <= BLOCK)))
    hot = items.where(F.col("k") > BLOCK)
    for step in SPLITS:
        if hot.isEmpty():
            break
        first = [F.first(x).alias(x) for x in ("d", "p", "left", "bytes")]
        parts = _split(hot, step).groupBy("key", "code").agg(F.sum("c").alias("c"), *first)
        q = F.shiftleft("p", 16).bitwiseOR(F.shiftleft((F.length("bytes") - (WINDOW - 1)).cast("long"), 8)).bitwiseOR(F.col("left").cast("long"))
        parts = scratch.table(parts.withColumn("q", q), f"parts-{step}")
        alone, mixed = _sorted_out(parts, scratch, f"parts-{step}")
        items = scratch.table(mixed.select("key", "k", "d", "p", "left", "c", "bytes"), f"cut-{step}")
        out = out.unionByName(alone).unionByName(_grouped(items.where(F.col("k") <= BLOCK)))
        hot = items.where(F.col("k") > BLOCK)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes as text) of every row."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffix")
    rows = scratch.table(keyed(docs, text, keep), "rows")
    by = single_windows(rows, scratch).groupBy("d").agg(F.collect_list(F.struct("p", "m")).alias("once"))
    both = rows.join(by, "d", "left").select(*keep, "body", "once")
    ddl = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + ["kept string"] * with_text)

    def run(batches):
        none = np.zeros(0, np.int64)
        for b in text_chunks(batches, "body"):
            n_bytes, removed, spans, sha, kept = [], [], [], [], []
            once = b.column("once")
            for i, body in enumerate(b.column("body").to_pylist()):
                p, m = (once[i].values.field(x).to_numpy() for x in ("p", "m")) if once[i].is_valid else (none, none)
                s, e = repeated_spans(len(body), p, m)
                parts = [body[x:y] for x, y in zip([0, *e], [*s, len(body)])]
                rest = b"".join(parts)
                n_bytes.append(len(body))
                removed.append(len(body) - len(rest))
                spans.append(len(s))
                sha.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode("utf-8", "ignore"))
            cols = [*(b.column(k) for k in keep), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return both.mapInArrow(run, ddl)


def repeated_spans(size: int, p: np.ndarray, m: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal spans [start, end) of ``size`` bytes that windows outside of the runs [p, p + m) cover."""
    order = np.argsort(p, kind="stable")
    p, e = p[order].astype(np.int64), (p + m)[order].astype(np.int64)
    s, t = np.concatenate([[0], e]), np.concatenate([p, [max(0, size - WINDOW + 1)]])  # windows between the runs
    s, t = s[t > s], t[t > s] + WINDOW - 1
    if not len(s):
        return [], []
    new = np.concatenate([[True], s[1:] > t[:-1]])
    return s[new].tolist(), t[np.concatenate([new[1:], [True]])].tolist()

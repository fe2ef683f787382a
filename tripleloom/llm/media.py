"""Media columns: chroma audio fingerprints and the alignment of recordings.

A binary column holds a recording: a RIFF/WAVE file with 8-, 16-, 24- or 32-bit PCM or 32-bit
floats, or, without that header, the bytes as 8-bit unsigned mono PCM at ``RATE``. Frames of ``FRAME`` samples are
folded into 12 pitch classes; over the resulting image (frames by classes) each of 16
rectangle filters compares sums that an integral image gives in four reads, and two bits
a filter make one packed 32-bit integer a position.

Recordings with equal fingerprints fold into one. Two others are linked if they share an
integer, and along the alignment that a histogram of offsets between equal integers gives
they overlap in ``MIN_OVERLAP`` positions at least and at most ``MAX_ERROR`` of the bits differ.

All pairs that share an integer are judged, each once: in the bucket of its smallest shared integer.
A bucket of over ``BLOCK`` members or ``CODES`` integers is dealt over blocks that meet pairwise. A block hands on
a row for each of its linked recordings (how many links, the best partner, the smallest member that links
lead to inside the block), so links are counted without a row for each, and tasks have bounded size. The
judging costs the pairs that share an integer, which grow with the square of a bucket. Recordings shorter
than ``MIN_OVERLAP`` positions can have no link, and take no part.

Defined cases: a null or empty recording, one shorter than a window of filters, or a WAVE file
of another coding has no integers, an empty digest and no match; silence has the same
integer throughout; long recordings are transformed in bounded pieces of frames and compared
in whole; a null id matches nothing and has no class; repeated rows match as equal recordings, rows
that repeat an id with another recording are linked as others are; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, partitions, ship, text_chunks
from .minhash import _Links

RATE, FRAME, HOP, LOW_HZ, HIGH_HZ = 8000, 1024, 512, 60.0, 3500.0
FILTERS, SPAN = 16, 8
#: Edges between the four levels of a filter's log ratio.
LEVELS = (-0.35, 0.0, 0.35)
MAX_ERROR, MIN_OVERLAP = 0.2, 4
BLOCK, CODES, VOTES = 1024, 1 << 21, 1 << 20
#: Longest recordings, in integers, that are aligned many at once, in matrices of these widths.
WIDTHS = (16, 64, 256, 1024)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters(n: int = FILTERS, span: int = SPAN):
    """``n`` rectangle filters (kind, first class, classes, width) by rule: kinds in turn, classes and widths spread evenly."""
    out = []
    for k in range(n):
        height = 2 + (k * 5) % 9
        out.append((k % 4, (k * 7) % (12 - height + 1), height, 2 + 2 * ((k * 3) % (span // 2))))
    return out


_FILTERS = filters()


def decode(raw: bytes | None) -> tuple[np.ndarray, int]:
    """(mono samples from -1 to 1, sample rate)."""
    if not raw:
        return np.zeros(0, np.float32), RATE
    if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE":
        at, coding, channels, rate, bits, body = 12, 1, 1, RATE, 8, b""
        while at + 8 <= len(raw):
            name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
            part = raw[at + 8 : at + 8 + size]
            if name == b"fmt " and len(part) >= 16:
                coding, channels, rate, bits = struct.unpack("<HHI6xH", part[:16])
                if coding == 0xFFFE and len(part) >= 26:  # extensible: the coding stands further on
                    coding = struct.unpack("<H", part[24:26])[0]
            elif name == b"data":
                body = part
            at += 8 + size + (size & 1)
        whole = body[: len(body) // max(1, bits // 8) * max(1, bits // 8)]
        if (coding, bits) == (1, 8):
            x = (np.frombuffer(whole, np.uint8).astype(np.float32) - 128) / 128
        elif (coding, bits) == (1, 16):
            x = np.frombuffer(whole, "<i2").astype(np.float32) / 32768
        elif (coding, bits) == (1, 24):
            parts = np.frombuffer(whole, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) / 2.0**31).astype(np.float32)
        elif (coding, bits) == (1, 32):
            x = (np.frombuffer(whole, "<i4") / 2.0**31).astype(np.float32)
        elif (coding, bits) == (3, 32):
            x = np.nan_to_num(np.frombuffer(whole, "<f4"), posinf=0.0, neginf=0.0).clip(-1, 1)
        else:
            x = np.zeros(0, np.float32)
        channels = max(1, channels)
        return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), max(1, rate)
    return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128, RATE


def _classes(rate: int):
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    ok = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    fold = np.zeros((len(hz), 12), np.float32)
    fold[np.flatnonzero(ok), np.round(12 * np.log2(hz[ok] / 440.0)).astype(int) % 12] = 1
    return fold


_fold_cache: dict[int, np.ndarray] = {}


def chroma(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12) energies of pitch classes, each frame scaled to length one (silence to zero)."""
    n = (len(x) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    if rate not in _fold_cache:
        _fold_cache[rate] = _classes(rate)
    window = np.hanning(FRAME).astype(np.float32)
    out = []
    for at in range(0, n, 2048):  # long recordings in bounded pieces
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[at * HOP : (min(n, at + 2048) - 1) * HOP + 1 : HOP]
        power = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * window, axis=1)).astype(np.float32) ** 2
        out.append(power @ _fold_cache[rate])
    c = np.concatenate(out)
    norm = np.sqrt((c**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, c / np.maximum(norm, 1e-6), 0)


def pack(image: np.ndarray) -> np.ndarray:
    """Packed integers of a chroma image, one for each position with ``SPAN`` frames."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13), np.float64)
    total[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)
    t = np.arange(n)

    def area(t0, t1, c0, c1):
        return total[t + t1, c1] - total[t + t0, c1] - total[t + t1, c0] + total[t + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in _FILTERS:
        half, mid, third = w // 2, c + h // 2, max(1, w // 3)
        if kind == 0:  # earlier against later
            a, b = area(0, half, c, c + h), area(half, w, c, c + h)
        elif kind == 1:  # lower against higher classes
            a, b = area(0, w, c, mid), area(0, w, mid, c + h)
        elif kind == 2:  # checkerboard
            a = area(0, half, c, mid) + area(half, w, mid, c + h)
            b = area(half, w, c, mid) + area(0, half, mid, c + h)
        else:  # middle against both ends
            a, b = area(third, w - third, c, c + h) if w > 2 * third else area(0, half, c, c + h), area(0, w, c, c + h)
        level = np.searchsorted(LEVELS, np.log((a + 0.05) / (b + 0.05)), side="right")
        out = out << np.uint32(2) | _GRAY[level]
    return out


def fingerprint(raw: bytes | None) -> np.ndarray:
    x, rate = decode(raw)
    return pack(chroma(x, rate))


def align(a: np.ndarray, b: np.ndarray):
    """(offset of b in a, overlap, bit error rate) by the fullest bin of the offset histogram; None if nothing is shared."""
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    n = hi - lo
    if not n.sum():
        return None
    # every place of a common integer votes; those of very many pairs of places by convolution
    size = len(a) + len(b) - 1
    votes = np.zeros(size, np.int64)
    values, which, count = np.unique(b, return_inverse=True, return_counts=True)
    heavy = (n * count[which]) > 64 * size
    for v in np.unique(which[heavy]).tolist():
        wide = 1 << size.bit_length()
        both = np.fft.rfft(a == values[v], wide) * np.fft.rfft((b == values[v])[::-1], wide)
        votes += np.rint(np.fft.irfft(both, wide)[:size]).astype(np.int64)
    n = np.where(heavy, 0, n)
    ends = np.cumsum(n)
    at = 0
    while at < len(b):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + VOTES, "right")))
        m = n[at:to]
        place = np.repeat(lo[at:to], m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
        votes += np.bincount(order[place] - np.repeat(np.arange(at, at + len(m)), m) + len(b) - 1, minlength=size)
        at = to
    k = int(votes.argmax()) - len(b) + 1
    s, e = max(0, k), min(len(a), len(b) + k)
    wrong = np.bitwise_count(a[s:e] ^ b[s - k : e - k]).sum()
    return k, e - s, float(wrong) / (32 * max(1, e - s))


def align_many(others: np.ndarray, lengths: np.ndarray, mine: np.ndarray):
    """Offsets, overlaps and wrong bits as :func:`align` has them of ``mine`` in each row of ``others`` (filled up with -1)."""
    m, width = others.shape
    n = len(mine)
    votes = np.zeros((m, width + n - 1), np.int16)
    for p, x in enumerate(mine.tolist()):
        votes[:, n - 1 - p : n - 1 - p + width] += others == x
    k = votes.argmax(1) - n + 1
    at = np.arange(width)[None, :] - k[:, None]
    both = (at >= 0) & (at < n) & (others >= 0)
    wrong = np.bitwise_count(others ^ mine[at.clip(0, n - 1)]) * both
    return k, np.minimum(lengths, n + k) - np.maximum(k, 0), wrong.sum(1, dtype=np.int64)


def _apart(codes, code: int) -> np.ndarray:
    """Which two recordings share no integer below ``code``."""
    below = [np.unique(c[c < code]) for c in codes]
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in below])
    _, of, count = np.unique(np.concatenate(below), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    owner, of = owner[count[of] > 1], column[of[count[of] > 1]]
    shared = np.zeros((len(codes), len(codes)), np.float32)
    for at in range(0, int((count > 1).sum()), 512):
        part = (of >= at) & (of < at + 512)
        has = np.zeros((len(codes), 512), np.float32)
        has[owner[part], of[part] - at] = 1
        shared += has @ has.T
    return shared == 0


def judge(code: int, ids: np.ndarray, side: np.ndarray | None, codes):
    """(links, best, root) of recordings that all hold ``code``, over the pairs that share no smaller integer.

    ``ids`` ascend; with ``side`` only pairs of different sides count. ``links``: how many linked partners;
    ``best``: (bit error, partner, offset, overlap) of the fewest errors among those of smaller ids, or None;
    ``root``: the first recording that links lead to.
    """
    size = len(ids)
    length = np.array([len(c) for c in codes])
    may = np.tri(size, size, -1, dtype=bool) & _apart(codes, code)
    if side is not None:
        may &= side[:, None] != side[None, :]
    kind = np.searchsorted(WIDTHS, length)
    rows, place = [], np.zeros(size, np.int64)
    for w in range(len(WIDTHS)):
        mine = np.flatnonzero(kind == w)
        wide = np.full((len(mine), int(length[mine].max(initial=0))), -1, np.int64)
        for r, i in enumerate(mine):
            wide[r, : length[i]] = codes[i]
        rows.append(wide)
        place[mine] = np.arange(len(mine))
    links, best, root = np.zeros(size, np.int64), [None] * size, np.arange(size)
    for i in range(size):
        found = []  # (partners, offsets, overlaps, wrong bits)
        with_ = np.flatnonzero(may[i])
        if not len(with_):
            continue
        short = kind[i] < len(WIDTHS)
        mine = codes[i].astype(np.int64)
        for w in np.unique(kind[with_]).tolist():
            y = with_[kind[with_] == w]
            if short and w < len(WIDTHS):
                found.append((y, *align_many(rows[w][place[y]], length[y], mine)))
            else:
                got = [align(codes[j], codes[i]) for j in y]
                found.append((y, *(np.array([g[c] for g in got]) for c in (0, 1)), np.array([round(g[2] * 32 * g[1]) for g in got])))
        y, k, over, wrong = (np.concatenate(c) for c in zip(*found))
        error = wrong / (32 * np.maximum(1, over))
        ok = (error <= MAX_ERROR) & (over >= MIN_OVERLAP)
        if not ok.any():
            continue
        y, k, over, error = y[ok], k[ok], over[ok], error[ok]
        links[i] += len(y)
        links[y] += 1
        joined = np.unique(root[y])
        root[np.isin(root, joined)] = joined[0]
        root[i] = joined[0]
        less = np.flatnonzero(ids[y] < ids[i])
        if len(less):
            j = less[np.lexsort((ids[y[less]], error[less]))[0]]
            best[i] = (float(error[j]), int(ids[y[j]]), int(k[j]), int(over[j]))
    return links, best, root


def fingerprints(rows: DataFrame, id_column: str, media: str) -> DataFrame:
    """id, n, sha256 and codes (packed integers as bytes) of every recording."""
    src = rows.select(F.col(id_column).cast("long").alias("id"), F.col(media).cast("binary").alias("raw"))

    def run(batches):
        for b in text_chunks(batches, "raw"):
            got = [fingerprint(x) for x in b.column("raw").to_pylist()]
            raw = [x.astype("<u4").tobytes() for x in got]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in got], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array(raw, pa.binary())], names=["id", "n", "sha256", "codes"])

    return src.mapInArrow(run, "id long, n long, sha256 string, codes binary")


def _linked(dealt: DataFrame) -> DataFrame:
    """rep, links, root and best partner, a row for each linked recording of each block (code, x, y) of ``dealt``."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("bit_error", pa.float64()), ("centre", pa.int64()), ("offset", pa.int64()), ("overlap", pa.int64())])

    def block(held):
        t = pa.concat_tables(held).sort_by([("id", "ascending"), ("rep", "ascending")])
        code, x, y = (t.column(c)[0].as_py() for c in ("code", "x", "y"))
        reps = t.column("rep").to_numpy()
        codes = [np.frombuffer(c, "<u4") for c in t.column("codes").to_pylist()]
        links, best, root = judge(code, t.column("id").to_numpy(), None if x == y else t.column("side").to_numpy(), codes)
        some = np.flatnonzero(links)
        parts = [[best[i] and best[i][c] for i in some] for c in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([reps[some], links[some], reps[root[some]], *parts], schema)], schema=schema)

    def run(batches):
        held, now = [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            k = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("code", "x", "y")], 1)
            edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)])) if len(k) else np.zeros(0, np.int64)
            for at, to in zip(edge, [*edge[1:], len(k)]):
                run_key = tuple(k[at].tolist())
                if run_key != now and held:
                    yield from block(held)
                    held = []
                now = run_key
                held.append(t.slice(at, to - at))
        if held:
            yield from block(held)

    found = "rep long, links long, root long, bit_error double, centre long, offset long, overlap long"
    return dealt.select("code", "x", "y", "side", "rep", "id", "codes").mapInArrow(run, found)


def match(rows: DataFrame, id_column: str, media: str) -> DataFrame:
    """id, n_codes, fingerprint_sha256, match_id, offset, overlap, bit_error, n_links, component_id for every recording.

    ``match_id`` is the smallest recording of the same fingerprint, or else the linked recording of a
    smaller id with the fewest bit errors (of equal ones the smallest); null without one, as for a smallest itself.
    ``n_links`` counts the other fingerprints that the recording's own is linked with; ``component_id`` is
    the smallest id that links and equal fingerprints lead to.
    """
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "media")
    all_ = scratch.table(fingerprints(rows, id_column, media), "fingerprints")
    known = all_.where("n > 0 and id is not null")
    reps = known.groupBy("sha256", "n").agg(F.min("id").alias("id"), F.any_value("codes").alias("codes"))
    reps = scratch.table(reps.withColumn("rep", F.monotonically_increasing_id()), "recordings")  # written, so that a recording keeps its number
    able = reps.where(F.col("n") >= MIN_OVERLAP)

    def codes(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                each = [np.unique(np.frombuffer(x, "<u4")) for x in part.column("codes").to_pylist()]
                wide = [pa.array(np.repeat(part.column(c).to_numpy(), [len(e) for e in each])) for c in ("rep", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).astype(np.int64)), *wide], names=["code", "rep", "n"])

    bits = scratch.table(able.select("rep", "n", "codes").mapInArrow(codes, "code long, rep long, n long"), "bits")
    parts = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(CODES))).cast("int")
    busy = bits.groupBy("code").agg(F.count("*").alias("c"), parts.alias("parts")).where("c > 1").select("code", "parts")
    dealt = bits.join(busy, "code").select("code", "rep", F.pmod(F.hash("rep"), "parts").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("met"))
    dealt = dealt.select("code", "rep", F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y"), (F.col("own") > F.col("met")).cast("int").alias("side"))
    dealt = dealt.join(able.select("rep", "id", "codes"), "rep").repartition(partitions(spark), "code", "x", "y").sortWithinPartitions("code", "x", "y")
    linked = scratch.table(_linked(dealt), "linked")
    best = F.when(F.col("centre").isNotNull(), F.struct("bit_error", "centre", "offset", "overlap"))
    judged = linked.groupBy("rep").agg(F.sum("links").alias("n_links"), F.min(best).alias("m")).select("rep", "n_links", "m.*")
    links = _Links(spark, scratch, lambda pairs: pairs)  # judged already
    links.resolve(linked.where("rep <> root").select(F.least("rep", "root").alias("a"), F.greatest("rep", "root").alias("b")).distinct())
    named = links.named(reps.select("sha256", "n", "rep", F.col("id").alias("first")).withColumnRenamed("rep", "id")).withColumnRenamed("id", "rep")
    named = scratch.table(named.join(judged, "rep", "left"), "named")
    named = named.join(named.groupBy("root").agg(F.min("first").alias("least")), "root")
    out = all_.drop("codes").join(named, ["sha256", "n"], "left")
    copy = F.col("id").isNotNull() & (F.col("first") != F.col("id"))
    own = F.col("id") == F.col("first")
    return out.select(
        "id",
        F.col("n").alias("n_codes"),
        F.col("sha256").alias("fingerprint_sha256"),
        F.when(copy, F.col("first")).when(own, F.col("centre")).alias("match_id"),
        F.when(copy, F.lit(0).cast("long")).when(own, F.col("offset")).alias("offset"),
        F.when(copy, F.col("n")).when(own, F.col("overlap")).alias("overlap"),
        F.when(copy, F.lit(0.0)).when(own, F.col("bit_error")).alias("bit_error"),
        F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"),
    )

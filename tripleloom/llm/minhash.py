"""Near-duplicate detection: a multi-index Hamming join over b-bit MinHash signatures.

Signature: ``CHUNKS * WIDTH`` minima of hashed shingles, ``BITS`` bits kept of each. Two
signatures within Hamming distance ``DISTANCE = CHUNKS * (ERRORS + 1) - 1`` (components
that differ) have, by pigeonhole, a chunk with at most ``ERRORS`` differing components;
every choice of ``ERRORS`` components to leave out of a chunk gives a key, so all pairs
under the distance share a key: guaranteed, whatever the data. At similarity 0.85 a pair
is over the distance with probability about 1e-6, at 0.8 about 2e-4. Candidates are then
held to an exact bound: with the signature goes a parity sketch of the whole set, ``SKETCH``
bits, of which each shingle turns one. Two sketches differ in no more bits than the sets do
in shingles, so a pair whose sketches differ in more than the similarity allows for sets of
these sizes is no link, and no link is lost.

Pairs are never expanded inside a bucket:

1. Documents with the same shingle set (128-bit digest) fold into their smallest id.
2. Each is paired with the smallest id of all its buckets, filtered by signature distance
   and confirmed on the full shingle sets; confirmed pairs are contracted (one confirmation
   for each larger component and round).
3. Buckets that still hold several components compare signatures across components, in
   blocks of bounded size: of a large bucket the largest component is dealt over blocks, and the
   others meet every block. Where that makes many pairs a member, each component of a block of over
   ``FEW`` pairs within the distance a member is first confirmed with its nearest other alone, round by round
   as long as that joins many; then all pairs within the distance that still lie between components are
   confirmed. A later round deals only members that had a partner within the distance in such a block:
   others have none in any round, as signatures stay and components only merge.

So a hot group of near copies costs its size times the number of keys, and the result is
the same as that of all pairs. Links and components stay distributed; only counts reach
the driver. Lineage is cut by tables in the shared folder.

Defined cases (:func:`near_duplicate_rows`): null and empty texts have an empty set, linked
with nothing; texts of one to four words have one shingle, the whole sequence; rows are
compared by numbers of their own, so rows that repeat an id, or have none, are documents too;
a component is named by its smallest id, null if no row of it has one; very long texts are
read in whole, their minima in pieces of 1024 shingles; an empty table gives no rows; extra
columns are ignored. There are no ties: equal sets are one, and ids order the rest.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, Vocab, doc_words, ship, text_chunks

SHINGLE, CHUNKS, WIDTH, ERRORS, BITS = 5, 12, 5, 1, 16
SIZE = CHUNKS * WIDTH
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Bits of the parity sketch that bounds the difference of two sets from below.
SKETCH = 2048
BYTES = 2 * SIZE + SKETCH // 8
#: Rows of one side of a block in step 3, and rows of a counted table up to which it is broadcast (16 bytes a row).
BLOCK, SMALL = 2048, 200_000
#: Pairs a member of a mixed bucket may have before nearest components are joined first; a choice of plan, the links are the same.
LINEAR = 64
#: Pairs within the distance a member up to which a block hands all of them on at once; likewise a choice of plan.
FEW = 4

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every bit of the result depends on every bit of ``x``)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _coefficients(n: int):
    k = np.arange(1, n + 1, dtype=np.uint64)
    return mix(k * _P) | np.uint64(1), mix(k * _M1)


_A, _B = (x.astype(np.uint32)[:, None] for x in _coefficients(SIZE))


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between the ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Shingler:
    """texts -> arrays of distinct hashed shingles."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.vocab, self.hash = width, Vocab(), np.zeros(0, np.uint64)

    def sets(self, texts) -> list[np.ndarray]:
        import xxhash

        if self.vocab.full:
            self.vocab, self.hash = Vocab(), np.zeros(0, np.uint64)
        ids, off = doc_words(texts, words, self.vocab)
        fresh = list(itertools.islice(self.vocab, len(self.hash), None))
        if fresh:
            self.hash = np.concatenate([self.hash, np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))])
        w, k = self.hash[ids], self.width
        n = np.diff(off)
        rolled = np.zeros(max(0, len(w) - k + 1), np.uint64)
        for i in range(k):
            rolled = rolled * _P + w[i : len(w) - k + 1 + i]
        rolled = mix(rolled)
        out = []
        for i in range(len(texts)):
            a, b = off[i], off[i + 1]
            if n[i] >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif n[i]:
                h = np.zeros(1, np.uint64)
                for x in w[a:b]:
                    h = mix(h + x + np.uint64(n[i]))
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def signature(s: np.ndarray) -> bytes:
    """The b-bit minima of a set of hashes: SIZE of 16 bits; then the parity sketch."""
    low = np.full(SIZE, np.iinfo(np.uint32).max, np.uint32)
    u = (s >> np.uint64(32)).astype(np.uint32)[None, :]
    for at in range(0, u.shape[1], 1024):
        low = np.minimum(low, (_A * u[:, at : at + 1024] + _B).min(1))
    low = mix(low.astype(np.uint64) + _P)
    odd = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return low.astype(np.uint16).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def unpack(sigs) -> tuple[np.ndarray, np.ndarray]:
    """(rows, SIZE) of 16 bits and sketches of 64 bits a word."""
    raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, BYTES)
    return np.ascontiguousarray(raw[:, : 2 * SIZE]).view(np.uint16), np.ascontiguousarray(raw[:, 2 * SIZE :]).view(np.uint64)


def distances(x, y) -> tuple[np.ndarray, np.ndarray]:
    """Between rows of unpacked signatures: components that differ, and bits of the sketches that do."""
    return (x[0] != y[0]).sum(1), np.bitwise_count(x[1] ^ y[1]).sum(1, dtype=np.int64)


def close(x, y, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rows of unpacked signatures within the join's distance whose sketches allow the similarity num/den for sets of ``sizes`` in all."""
    d, bits = distances(x, y)
    return (d <= DISTANCE) & (bits * (den + num) <= sizes * (den - num))


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of key minima that share a key, the number (column of :func:`bucket_keys`) of the first that they share."""
    same = (x == y).reshape(len(x), CHUNKS, WIDTH)
    hit = [same[:, :, [k for k in range(WIDTH) if k not in out]].all(2) for out in itertools.combinations(range(WIDTH), ERRORS)]
    return np.concatenate(hit, 1).argmax(1)


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, keys) of signatures (rows, SIZE): for each chunk and each choice of components left out, a hash of the rest."""
    rows = len(sig)
    chunk = sig.reshape(rows, CHUNKS, WIDTH).astype(np.uint64)
    keys = []
    for left_out in itertools.combinations(range(WIDTH), ERRORS):
        kept = [k for k in range(WIDTH) if k not in left_out]
        h = np.full((rows, CHUNKS), np.uint64(sum(1 << k for k in kept)), np.uint64) * _P + np.arange(CHUNKS, dtype=np.uint64) * _M1
        for k in kept:
            h = mix(h + chunk[:, :, k] * _M2 + _P)
        keys.append(h)
    return np.concatenate(keys, 1).view(np.int64)


def signatures(docs: DataFrame, text: str, width: int) -> DataFrame:
    """doc_id, n, h1, h2 (digest of the set), sig."""
    src = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("__text"))

    def run(batches):
        shingler = Shingler(width)
        for b in text_chunks(batches, "__text"):
            sets = shingler.sets(b.column("__text").to_pylist())
            n = [len(s) for s in sets]
            h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            h2 = np.array([mix(s ^ _P).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            sig = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.array(sig, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"])

    return src.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def _keyed(reps: DataFrame) -> DataFrame:
    """key, slot (the key's number) and id for every key of every signature."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                k = bucket_keys(unpack(part.column("sig").to_pylist())[0])
                wide = lambda c: pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), k.shape[1]))
                slot = pa.array(np.tile(np.arange(k.shape[1], dtype=np.int16), len(k)))
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), slot, wide("id")], names=["key", "slot", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, slot short, id long")


def _near(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose signatures are within the distance and whose sizes allow the similarity."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                sizes = part.column("n_a").to_numpy() + part.column("n_b").to_numpy()
                ok = close(unpack(part.column("sig_a").to_pylist()), unpack(part.column("sig_b").to_pylist()), sizes, num, den)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, docs: DataFrame, text: str, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough.

    Where the pairs are few (counted), their ids cut the texts before any is moved. Each text of
    a ``b`` is then moved twice and that of an ``a`` once; a frequent ``a`` is a skewed join,
    which Spark splits, and its set is made once for a run of partners.
    """
    few = pairs.count() <= SMALL
    texts = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")

    def side(x):
        out = texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
        return out.join(F.broadcast(pairs.select(x).distinct()), x, "left_semi") if few else out

    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        shingler, now, mine = Shingler(width), None, None
        for b in text_chunks(batches, "text_b"):
            sets = shingler.sets(b.column("text_b").to_pylist())
            first, a, other = b.column("text_a"), b.column("a").to_pylist(), b.column("b").to_pylist()
            ok = []
            for i, s in enumerate(sets):
                t = first[i].as_py() if now is None or a[i] != now[0] else now[1]
                if (a[i], t) != now:
                    now = (a[i], t)
                    (mine,) = shingler.sets([t])
                both_n = len(np.intersect1d(mine, s, assume_unique=True))
                ok.append(bool(both_n) and both_n * den >= num * (len(mine) + len(s) - both_n))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most ``SMALL`` rows (it is counted, from its footers)."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _jump(parent: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, root) of a forest (id, root) in which every id points to a smaller one, by pointer doubling."""
    step = 0
    now = scratch.table(parent, f"{tag}-{step}")
    while True:
        up = _small(now)
        out = now.withColumn("moved", F.lit(False))
        for k in range(2):  # two hops a round
            hop = up.select(F.col("id").alias("root"), F.col("root").alias("up"))
            out = out.join(hop, "root", "left").select("id", F.coalesce("up", "root").alias("root"), (F.col("moved") | F.col("up").isNotNull()).alias("moved"))
        out = scratch.table(out, f"{tag}-{step + 1}")
        scratch.drop(f"{tag}-{step}")
        step += 1
        if out.where("moved").isEmpty():
            return out.drop("moved")
        now = out.drop("moved")


class _Links:
    """Contracts confirmed pairs; ``root`` (id, root) has the ids that are not their own root."""

    def __init__(self, spark, scratch: Scratch, confirm):
        self.spark, self.scratch, self.confirm, self.k = spark, scratch, confirm, 0
        self.root: DataFrame | None = None
        self.failed: list[DataFrame] = []  # pairs that were confirmed alone, and were not

    def rooted(self, pairs: DataFrame) -> DataFrame:
        """Pairs between different components, with lo and hi, the smaller and the larger root."""
        if self.root is None:
            return pairs.where("a <> b").select("a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        r = _small(self.root)
        x = pairs.join(r.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(r.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
        x = x.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")
        return x.select("a", "b", F.least("ra", "rb").alias("lo"), F.greatest("ra", "rb").alias("hi"))

    def resolve(self, pairs: DataFrame, ready: bool = False) -> int:
        """Confirm and contract until no pair is left between components; returns how many components were joined to others.

        First the pair of each larger component with its smallest neighbour; then, mostly
        few, all that are left between components, which need no more texts after that.
        ``ready`` pairs have lo and hi and lie between components.
        """
        s, sure, tried, joined = self.scratch, False, False, 0
        while True:
            self.k += 1
            k = self.k
            left = pairs if ready else self.rooted(pairs)
            if ready:
                for f in self.failed:
                    left = left.join(_small(f), ["a", "b"], "left_anti")
            left, ready = s.table(left, f"left-{k}"), False
            if left.isEmpty():
                return joined
            if tried and not sure:
                left, sure = s.table(left.join(self.confirm(left.select("a", "b")), ["a", "b"], "left_semi"), f"sure-{k}"), True
            pick = left.groupBy("hi").agg(F.min(F.struct("lo", "a", "b")).alias("p")).select("hi", "p.lo", "p.a", "p.b")
            pairs = left.select("a", "b")
            if not sure:
                tried = True
                pick = s.table(pick, f"pick-{k}")
                pairs = pairs.join(_small(pick.select("a", "b")), ["a", "b"], "left_anti")
                yes = s.table(self.confirm(pick.select("a", "b")), f"yes-{k}")
                self.failed.append(s.table(pick.select("a", "b").join(yes, ["a", "b"], "left_anti"), f"no-{k}"))
                pick = pick.join(yes, ["a", "b"], "left_semi")
            hooked = _jump(pick.select(F.col("hi").alias("id"), F.col("lo").alias("root")), s, f"hook-{k}")
            joined += hooked.count()
            if self.root is None:
                self.root = hooked
            else:
                up = _small(hooked).select(F.col("id").alias("root"), F.col("root").alias("up"))
                moved = self.root.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
                self.root = s.table(moved.unionByName(hooked), f"root-{k}")

    def named(self, ids: DataFrame) -> DataFrame:
        """``ids`` (with a column id) and the root of each."""
        if self.root is None:
            return ids.withColumn("root", F.col("id"))
        return ids.join(_small(self.root), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _mixed(rows: DataFrame, links: _Links, scratch: Scratch, tag: str) -> tuple[DataFrame, bool]:
    """(the rows (key, slot, id) of buckets with several components, with root, and the largest component, its members and
    the others; whether the buckets have over ``LINEAR`` pairs between components a member)."""
    rooted = scratch.table(links.named(rows.select("key", "slot", "id")), f"{tag}-rooted")
    by = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    size = by.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("big"), F.max("c").alias("n_big"), (F.sum("c") - F.max("c")).alias("n_small"))
    size = scratch.table(size.where("n_small > 0"), f"{tag}-sizes")
    most = F.sum(F.col("n_big") * F.col("n_small") + F.col("n_small") * F.col("n_small") / 2)
    many = bool(size.agg(F.coalesce(most > LINEAR * F.sum(F.col("n_big") + F.col("n_small")), F.lit(False))).first()[0])
    rows = scratch.table(rooted.join(_small(size), "key"), f"{tag}-rows")
    scratch.drop(f"{tag}-rooted")
    return rows, many


def _across(rows: DataFrame, reps: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different components (lo, hi) in mixed buckets and within the distance.

    ``nearest``: of blocks with over ``FEW`` pairs a member one for each component, and the members (key, slot, id) that have pairs.
    A bucket of up to ``BLOCK`` members is one block, each member in it once.
    """
    cols = ["key", "slot", "id", "root"]
    fits = F.col("n_big") + F.col("n_small") <= BLOCK
    whole = rows.where(fits).select(*cols, F.lit(0).alias("x"), F.lit(-2).alias("y"), F.lit(2).alias("side"))
    rows = rows.where(~fits)
    h = lambda n: F.pmod(F.hash("id"), F.ceil(F.col(n) / F.lit(BLOCK)).cast("int"))
    last = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int") - 1
    of_big = F.col("root") == F.col("big")
    big = rows.where(of_big).select(*cols, h("n_big").alias("x"), F.lit(-1).alias("y"), F.lit(0).alias("side"))
    meet = rows.where(~of_big).select(*cols, F.explode(F.sequence(F.lit(0), last("n_big"))).alias("x"), F.lit(-1).alias("y"), F.lit(1).alias("side"))
    small = rows.where(~of_big & (F.col("n_small") > 1)).withColumn("o", h("n_small"))
    one = small.select(*cols, F.col("o").alias("x"), F.explode(F.sequence(F.col("o"), last("n_small"))).alias("y"), F.lit(0).alias("side"))
    two = small.select(*cols, F.explode(F.sequence(F.lit(0), F.col("o"))).alias("x"), F.col("o").alias("y"), F.lit(1).alias("side"))
    dealt = whole.unionByName(big).unionByName(meet).unionByName(one).unionByName(two).join(reps.select("id", "n", "sig"), "id")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")

    few = FEW if nearest else None

    def run(batches):
        held, now = [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            k = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y")], 1)
            edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)])) if len(k) else np.zeros(0, np.int64)
            for at, to in zip(edge, [*edge[1:], len(k)]):
                run_key = tuple(k[at].tolist())
                if run_key != now and held:
                    yield from _block(held, num, den, few)
                    held = []
                now = run_key
                held.append(t.slice(at, to - at))
        if held:
            yield from _block(held, num, den, few)

    return dealt.select("key", "x", "y", "side", "slot", "id", "root", "n", "sig").mapInArrow(run, "a long, b long, lo long, hi long, key long, slot short, id long").distinct()


def _block(held, num: int, den: int, few: int | None):
    t = pa.concat_tables(held)
    side, n = t.column("side").to_numpy(), t.column("n").to_numpy()
    ids, root = t.column("id").to_numpy(), t.column("root").to_numpy()
    keys, check = unpack(t.column("sig").to_pylist())
    slot = t.column("slot")[0].as_py()
    _, of, count = np.unique(root, return_inverse=True, return_counts=True)
    once = side[0] == 2  # all against all: those of the largest component with none of their own
    big = of == count.argmax() if once else np.zeros(len(root), bool)
    left, right = (np.flatnonzero(~big), np.arange(len(root))) if once else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if len(left) > len(right):
        left, right = right, left
    best = np.full(of.max() + 1, np.iinfo(np.int64).max)  # by component: distance, row, row
    live, kept, pairs = np.zeros(len(root), bool), [], 0
    for i in left:
        r = right[(root[right] != root[i]) & (big[right] | (right > i) | (not once))]
        r = r[(np.minimum(n[r], n[i]) * den >= np.maximum(n[r], n[i]) * num)]
        r = r[close((keys[r], check[r]), (keys[i], check[i]), n[r] + n[i], num, den)]
        if len(r):
            r = r[first_shared(keys[r], keys[i][None, :]) == slot]  # each pair once, from the first bucket it shares
        if not len(r):
            continue
        if few is None:
            yield _pairs(ids, root, np.full(len(r), i), r)
            continue
        pairs += len(r)
        live[i] = live[r] = True
        if pairs <= few * len(root):
            kept.append((np.full(len(r), i), r))
        # by the share of the sets that differs, at least
        v = (np.bitwise_count(check[r] ^ check[i]).sum(1, dtype=np.int64) * 10_000 // (n[r] + n[i])) << 48 | int(i) << 24 | r
        np.minimum.at(best, of[r], v)
        best[of[i]] = min(best[of[i]], v.min())
    if not pairs:
        return
    if pairs <= few * len(root):
        yield _pairs(ids, root, *(np.concatenate(x) for x in zip(*kept)))
        return
    best = np.unique(best[best < np.iinfo(np.int64).max])
    yield _pairs(ids, root, best >> 24 & 0xFFFFFF, best & 0xFFFFFF)
    yield _found(slice(4, 7), [np.full(live.sum(), t.column("key")[0].as_py()), np.full(live.sum(), slot), ids[live]])


def _pairs(ids, root, i, r) -> pa.RecordBatch:
    cols = [np.minimum(ids[i], ids[r]), np.maximum(ids[i], ids[r]), np.minimum(root[i], root[r]), np.maximum(root[i], root[r])]
    return _found(slice(4), cols)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("key", pa.int64()), ("slot", pa.int16()), ("id", pa.int64())])


def _found(which: slice, columns) -> pa.RecordBatch:
    """A batch of :func:`_across` with these columns, the others null."""
    full = dict(zip(_FOUND.names[which], columns))
    size = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.array(full[f.name], f.type) if f.name in full else pa.nulls(size, f.type) for f in _FOUND], schema=_FOUND)


def near_duplicates(docs: DataFrame, text: str = "text", num: int = 80, den: int = 100, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``, whose ids tell rows apart.

    Documents are linked where ``den * |A & B| >= num * |A | B|`` for their sets of
    ``width``-word shingles; a component is named by its smallest id.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "minhash")
    sigs = scratch.table(signatures(docs, text, width), "signatures")
    full = sigs.where("n > 0 and doc_id is not null")
    reps = scratch.table(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.any_value("sig").alias("sig")), "sets")
    reps_now = reps.select("id", "n", "sig")
    keyed = _keyed(reps_now)
    centre = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("key", "a")
    shared = scratch.table(keyed.join(centre, "key"), "shared")  # the rows of buckets with two members or more
    links = _Links(spark, scratch, lambda p: _confirm(p, docs, text, width, num, den))
    first = shared.where("id <> a").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    links.resolve(scratch.table(_near(first, reps_now, num, den), "first"))
    rows, nearest, k = shared, True, 0
    while True:
        k += 1
        rows, many = _mixed(rows, links, scratch, f"mixed-{k}")
        if rows.isEmpty():
            break
        nearest = nearest and many
        found = _across(rows, reps_now, num, den, nearest)
        found = scratch.table(found, f"found-{k}") if nearest else found
        joined = links.resolve(found.where("a is not null").select("a", "b", "lo", "hi"), ready=True)
        if not nearest:
            break
        rows = found.where("a is null").select("key", "slot", "id")  # all other pairs are settled
        nearest = joined > BLOCK // 4  # a choice of plan: few joins left are as well found with all pairs
    named = links.named(reps.select("h1", "h2", "n", "id")).select("h1", "h2", "n", F.col("root").alias("component"))
    out = sigs.join(named, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicate_rows(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), **options) -> DataFrame:
    """``keep`` columns, text, n_shingles, component_id, kept and first for every row of ``docs``, whatever their ids.

    ``kept`` holds for the rows whose id names their component, ``first`` for one of them (or, where no row of a
    component has an id, for one row). ``options`` are those of :func:`near_duplicates`.
    """
    scratch = Scratch(docs.sparkSession, "near_rows")
    # written, so that a row has the same number in every job
    rows = scratch.table(docs.select(*keep, F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row")), "rows")
    groups = near_duplicates(rows.select(F.col("__row").alias("doc_id"), F.col("__text").alias("text")), **options)
    groups = groups.select(F.col("doc_id").alias("__row"), "n_shingles", F.col("component_id").alias("__root"))
    named = scratch.table(rows.select("doc_id", "__row").join(groups, "__row"), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    by = scratch.table(named.groupBy("__root").agg(first.alias("m")).select("__root", F.col("m.doc_id").alias("component_id"), F.col("m.__row").alias("__first")), "components")
    out = named.drop("doc_id").join(by, "__root")
    out = out.select("__row", "n_shingles", "component_id", (F.col("__row") == F.col("__first")).alias("first"))
    out = rows.join(out, "__row")
    return out.select(*keep, F.col("__text").alias(text), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first")).alias("kept"), "first")

"""Exact top-k by inner product: a dual-tree search over cover trees.

Vectors are dealt to the nearest of at most ``PIVOTS`` pivots. On the small table of cells, a
pair of a query cell and a candidate cell is dropped if ``a.b + r|b| + s|a| + r s`` (pivots a
and b, covering radii r and s, the most any pair of their points can reach) is below the
worst k-th score among the cell's queries; nothing is shipped for it. That score starts from
a bounded sample of candidates: its k-th best is a lower bound. Cells beyond ``BLOCK`` rows are
split, so that a block is near one place and bounded however common a vector is.

What is left meets in tasks of a candidate block and a group of up to ``GROUP`` query blocks
of a cell: the candidates are indexed once, the query blocks stream past, each indexed by a
tree of its own, and pairs of nodes are skipped by the same rule, with k-th scores that rise
with what the search finds. Equal vectors in a block are one point with its ``k + 1`` smallest
ids, as no query can want more. The blocks' results are merged by the k best of each query.

Defined cases: vectors that are null or empty, hold null or non-finite components, or have no
id, take no part; vectors of different lengths meet over the shorter (more than ``MAX_DIM``
components are an error); a query never returns its own id; rows that repeat an id are one
candidate, or query, with the best of its scores; fewer candidates than k are all returned;
ties go to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, ship

BLOCK, QUERY_BLOCK, GROUP, LEAF, PIVOTS, SAMPLE, SHRINK, MAX_DIM = 8192, 1024, 64, 96, 1024, 4096, 1.4, 1 << 14


class CoverTree:
    """Nodes over a permutation of the points: centre, covering radius, range, children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x.astype(np.float64)
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(x), None, leaf) if len(x) else -1

    def _build(self, a: int, b: int, bound: float | None, leaf: int) -> int:
        pts = self.x[self.order[a:b]]
        centre = pts.mean(0)
        dist = np.sqrt(((pts - centre) ** 2).sum(1))
        radius = float(dist.max())
        children: list[int] = []
        if b - a > leaf and radius > 0:
            # cover the node's points by balls of a smaller radius around points of their own
            goal = min(radius, bound or radius) / SHRINK
            far = int(dist.argmax())
            nearest = np.full(b - a, np.inf)
            owner = np.zeros(b - a, np.int64)
            n = 0
            most = max(2, (b - a) // leaf)
            while n < most and (n < 2 or nearest.max() > goal):
                d = np.sqrt(((pts - pts[far]) ** 2).sum(1))
                closer = d < nearest
                owner[closer], nearest[closer] = n, d[closer]
                n += 1
                far = int(nearest.argmax())
                if nearest[far] == 0:
                    break
            if n > 1:
                by = np.argsort(owner, kind="stable")
                self.order[a:b] = self.order[a:b][by]
                ends = a + np.cumsum(np.bincount(owner, minlength=n))
                at = a
                for e in ends.tolist():
                    if e > at:
                        children.append(self._build(at, e, goal, leaf))
                    at = e
        self.nodes.append((centre, float(np.sqrt(centre @ centre)), radius, a, b, children))
        return len(self.nodes) - 1


class Points:
    """Candidates of a block, equal vectors folded, indexed once for any number of query blocks."""

    def __init__(self, x: np.ndarray, x_ids: np.ndarray):
        order = np.lexsort([x_ids, *x.T[::-1]])
        x, self.ids = x[order], x_ids[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
        first = np.flatnonzero(new)
        self.most = float(np.abs(x).max(initial=0))
        self.tree = CoverTree(x[first])
        self.x = x[first][self.tree.order]
        self.first, self.count = first[self.tree.order], np.diff(np.concatenate([first, [len(x)]]))[self.tree.order]


def search(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, points: Points, k: int):
    """(query row, id, score) of the k best of ``points`` for each query, those at or above ``floor`` only."""
    if not len(q):
        return (np.zeros(0, np.int64),) * 3
    tq, tx = CoverTree(q), points.tree
    qs, xs, x_ids, x_first = q[tq.order], points.x, points.ids, points.first
    if float(np.abs(q).max(initial=0)) * points.most * q.shape[1] < 2**52:  # products are exact in doubles
        qs, xs = qs.astype(np.float64), xs.astype(np.float64)
    x_count = np.minimum(points.count, k + 1)
    own, floor = q_ids[tq.order], floor[tq.order].astype(np.float64)
    best: list[list[tuple]] = [[] for _ in range(len(q))]
    kth = floor.copy()

    def limit(a, b):
        (ca, na, ra, *_), (cb, nb, rb, *_) = a, b
        return (float(ca @ cb) + ra * nb + rb * na + ra * rb) * (1 + 1e-12) + 1e-3 + 1e-9 * (na + ra) * (nb + rb)

    stack = [(limit(tq.nodes[tq.root], tx.nodes[tx.root]), tq.root, tx.root)]
    while stack:
        most, i, j = stack.pop()
        a, b = tq.nodes[i], tx.nodes[j]
        if most < kth[a[3] : a[4]].min():
            continue
        if a[5] and (not b[5] or a[2] >= b[2]):
            more = [(limit(tq.nodes[c], b), c, j) for c in a[5]]
        elif b[5]:
            more = [(limit(a, tx.nodes[c]), i, c) for c in b[5]]
        else:
            s = qs[a[3] : a[4]] @ xs[b[3] : b[4]].T
            hit = s >= kth[a[3] : a[4], None]
            for r in np.flatnonzero(hit.any(1)).tolist():
                row = a[3] + r
                mine = best[row]
                for c in np.flatnonzero(hit[r]).tolist():
                    at = x_first[b[3] + c]
                    v = int(s[r, c])
                    mine.extend([(-v, y) for y in x_ids[at : at + x_count[b[3] + c]].tolist() if y != own[row]])
                seen: dict[int, int] = {}
                for v, y in sorted(mine):  # an id once, with its best score
                    seen.setdefault(y, v)
                mine[:] = [(v, y) for y, v in seen.items()][:k]
                if len(mine) == k:
                    kth[row] = max(kth[row], -mine[-1][0])
            continue
        more.sort()  # the most promising pair is taken next
        stack.extend(more)
    rows = np.repeat(np.arange(len(q)), [len(m) for m in best])
    flat = [t for m in best for t in m]
    return tq.order[rows], np.array([t[1] for t in flat], np.int64), np.array([-t[0] for t in flat], np.int64)


def quantised(rows: DataFrame, vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id and v, the array of floor(scale * component), of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform(v, lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("v"))
    return rows


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of ``dim`` components, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, dim), np.int64)
    flat, off = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
    n = np.diff(off)
    if (n == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None, :] < n[:, None]] = flat
    return out


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Points far from each other, the top level of a cover of the sample."""
    x = sample.astype(np.float64)
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def top_k(rows: DataFrame, queries: Column, k: int = 20, vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of each row for which ``queries`` holds."""
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "topk")
    # repeated rows are one candidate: the floor and the groups of equal vectors count ids
    vecs = scratch.table(quantised(rows, vector, scale).distinct(), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, total = vecs.agg(F.max(F.size("v")), F.count("*")).first()
    if not total:
        return empty
    if dim > MAX_DIM:
        raise ValueError(f"a vector of {dim} components; the limit is {MAX_DIM}")
    sample = vecs.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toArrow()  # bounded: SAMPLE rows
    point_ids, first = np.unique(sample.column("vec_id").to_numpy(), return_index=True)
    points = _matrix(sample.column("v"), dim)[first].astype(np.float64)
    pivots = _pivots(points, max(1, min(PIVOTS, total // BLOCK)))
    shared = spark.sparkContext.broadcast((pivots, points, point_ids))

    def deal(batches):
        piv, pts, ids = shared.value
        norm = (piv**2).sum(1)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _matrix(part.column("v"), dim).astype(np.float64)
                cell = (norm[None, :] - 2 * x @ piv.T).argmin(1)
                far = np.sqrt(((x - piv[cell]) ** 2).sum(1))
                floor = np.full(len(x), -(2.0**62))
                ask = part.column("ask").to_numpy(zero_copy_only=False)
                mine = part.column("vec_id").to_numpy()
                if ask.any() and len(pts) > k:
                    s = x[ask] @ pts.T
                    s[mine[ask][:, None] == ids[None, :]] = -np.inf
                    low = np.partition(s, -k, axis=1)[:, -k]
                    floor[ask] = np.where(np.isfinite(low), low, -(2.0**62))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), part.column("ask"), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(floor)], names=["vec_id", "v", "ask", "cell", "far", "floor"])

    dealt = vecs.withColumn("ask", F.coalesce(queries, F.lit(False))).mapInArrow(deal, "vec_id long, v array<long>, ask boolean, cell int, far double, floor double")
    dealt = scratch.table(dealt, "dealt")
    asked = F.col("ask")
    cells = dealt.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("far").alias("far"),
        F.count_if(asked).alias("q_n"), F.max(F.when(asked, F.col("far"))).alias("q_far"), F.min(F.when(asked, F.col("floor"))).alias("floor"),
    )
    table = cells.orderBy("cell").collect()  # bounded: a row for each of at most PIVOTS cells
    met = _meeting(table, pivots)
    if not met:
        return empty
    parts = {r["cell"]: -(-r["n"] // BLOCK) for r in table}
    q_parts = {r["cell"]: -(-r["q_n"] // QUERY_BLOCK) for r in table}
    # bounded: at most PIVOTS rows of at most PIVOTS pairs
    by_query = F.broadcast(spark.createDataFrame([(q, q_parts[q], [(c, parts[c]) for a, c in met if a == q]) for q in sorted({a for a, _ in met})], "cell int, own int, other array<struct<cell:int, parts:int>>"))
    by_candidate = F.broadcast(spark.createDataFrame([(c, parts[c], [(q, -(-q_parts[q] // GROUP)) for q, b in met if b == c]) for c in sorted({b for _, b in met})], "cell int, own int, other array<struct<cell:int, parts:int>>"))
    place = lambda seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.col("own")).cast("int")
    every = lambda df: df.withColumn("o", F.explode("other")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("o.parts") - 1)))
    # the query set against all rows, in blocks; candidates stand before queries in each task
    c_side = every(dealt.join(by_candidate, "cell").withColumn("block", place(0)))
    c_side = c_side.select("cell", "block", F.col("o.cell").alias("q_cell"), F.col("at").alias("q_group"), F.lit(-1).alias("q_block"), "vec_id", "v", F.lit(0.0).alias("floor"))
    q_side = every(dealt.where("ask").join(by_query, "cell").withColumn("block", place(1)))
    q_side = q_side.select(F.col("o.cell").alias("cell"), F.col("at").alias("block"), F.col("cell").alias("q_cell"), F.floor(F.col("block") / GROUP).cast("int").alias("q_group"), F.col("block").alias("q_block"), "vec_id", "v", "floor")
    task = ["cell", "block", "q_cell", "q_group"]
    both = c_side.unionByName(q_side).repartition(*task).sortWithinPartitions(*task, "q_block")

    def solve(batches):
        now, points, held = None, None, []

        def run():
            nonlocal points
            t = pa.Table.from_batches(held)
            x, ids = _matrix(t.column("v"), dim), t.column("vec_id").to_numpy()
            if now[-1] < 0:
                points = Points(x, ids)
            elif points is not None:
                r, found, score = search(x, ids, t.column("floor").to_numpy(), points, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in (*task, "q_block")], 1)
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])).tolist()
            for at, to in zip(edge, [*edge[1:], len(key)]):
                mine = tuple(key[at].tolist())
                if mine != now:
                    if held:
                        yield from run()
                    if now is not None and mine[:-1] != now[:-1]:
                        points = None
                    now, held = mine, []
                held.append(b.slice(at, to - at))
        if held:
            yield from run()

    found = both.mapInArrow(solve, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _meeting(table, pivots: np.ndarray) -> list[tuple[int, int]]:
    """(query cell, candidate cell) pairs that may hold a score the query cell's worst k-th score does not rule out."""
    asked = [r for r in table if r["q_n"]]
    if not asked:
        return []
    q, c = np.array([r["cell"] for r in asked]), np.array([r["cell"] for r in table])
    a, b = pivots[q], pivots[c]
    na, nb = np.sqrt((a**2).sum(1)), np.sqrt((b**2).sum(1))
    r, s = np.array([x["q_far"] for x in asked]), np.array([x["far"] for x in table])
    most = a @ b.T + r[:, None] * nb[None, :] + na[:, None] * s[None, :] + r[:, None] * s[None, :]
    most = most * (1 + 1e-12) + 1e-3 + 1e-9 * (na + r)[:, None] * (nb + s)[None, :]
    i, j = np.nonzero(most >= np.array([x["floor"] for x in asked])[:, None])
    return list(zip(q[i].tolist(), c[j].tolist()))

"""Exact top-k by inner product: a dual-tree search over cover trees.

The first level of the tree is a set of pivots that lie far apart, chosen from a
bounded sample; every row belongs to its nearest pivot's region, and every region
is cut to blocks (see ``vector_blocks``). In each block of data and of queries a
cover tree is built: a node's points lie within its radius of one of its points,
and its children cover it by balls 1.3 times smaller.

For a query node with centre q, radius r and a data node with centre d, radius s,
no inner product exceeds <q,d> + |q|s + |d|r + rs. A pair of nodes is let go if
that is below the worst k-th score of the query node's group. The same bound on
whole blocks decides which blocks meet. Scores to compare with come from a first
round, in which each query block searches one block of its own region.

In many dimensions few pairs can be ruled out, whatever the index; then the work
is that of comparing all queries with all rows, in blocks.

Scores are whole numbers and exact: while they fit, products are taken in double
precision, which holds them exactly up to 2**53, else in 64-bit integers.

Defined results: rows whose id or vector is null, or whose vector holds a null or
non-finite component, take no part; vectors shorter than the longest count as
ending in zeros, empty ones score 0; a query's own id is no candidate; rows
repeated with the same id and vector are one candidate. With fewer candidates
than k all are returned; an empty table gives an empty result. Only the two named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.llm.vector_blocks import (
    BLOCK,
    QUERY_BLOCK,
    best_of,
    candidate_pairs,
    checkpointed,
    in_blocks,
    keep_best,
    matrix,
    sample_of,
    search,
    usable_vectors,
    with_region,
)

PIVOTS, SAMPLE, LEAF, SHRINK = 16, 2048, 64, 1.3
PACKED = "region int, part int, centre array<double>, radius double, ids binary, points binary, nodes binary"
FOUND = "query_id long, vec_id long, score long"


def _far_apart(points: np.ndarray, most: int) -> np.ndarray:
    """Points that are each the farthest from those before."""
    if not len(points):
        return points
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


class CoverTree:
    """Nodes over a permutation of points: centre, radius, range of points, range of children."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.centre, self.radius, self.lo, self.hi, self.first, self.last = [], [], [], [], [], []
        pending = [self._node(points, 0, len(points), 0)]
        while pending:
            node = pending.pop()
            lo, hi, radius = self.lo[node], self.hi[node], self.radius[node]
            if hi - lo <= LEAF or radius == 0:
                continue
            here = points[self.order[lo:hi]]
            owner = np.zeros(hi - lo, np.int64)
            gap = ((here - points[self.centre[node]]) ** 2).sum(axis=1)
            centres = [self.centre[node]]
            while gap.max() > (radius / SHRINK) ** 2:
                far = int(gap.argmax())
                to_far = ((here - here[far]) ** 2).sum(axis=1)
                closer = to_far < gap
                owner[closer], gap[closer] = len(centres), to_far[closer]
                centres.append(self.order[lo + far])
            moved = np.argsort(owner, kind="stable")
            self.order[lo:hi] = self.order[lo:hi][moved]
            sizes = np.bincount(owner, minlength=len(centres))
            self.first[node] = len(self.centre)
            at = lo
            for centre, size in zip(centres, sizes):
                if size:
                    pending.append(self._node(points, at, at + int(size), centre))
                    at += int(size)
            self.last[node] = len(self.centre)

    def _node(self, points: np.ndarray, lo: int, hi: int, centre: int) -> int:
        far = ((points[self.order[lo:hi]] - points[centre]) ** 2).sum(axis=1).max()
        for values, value in ((self.centre, centre), (self.radius, float(np.sqrt(far))), (self.lo, lo),
                              (self.hi, hi), (self.first, 0), (self.last, 0)):
            values.append(value)
        return len(self.centre) - 1

    def packed(self) -> np.ndarray:
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        centres = place[np.array(self.centre)]
        return np.stack([centres, self.lo, self.hi, self.first, self.last, self.radius], axis=1)


def _narrow(points: np.ndarray) -> np.ndarray:
    """Whole numbers in 16 bits, if they fit, behind a byte that says so."""
    small = np.abs(points).max(initial=0) < 1 << 15
    raw = points.astype(np.int16 if small else np.int64).tobytes()
    return bytes([2 if small else 8]) + raw


def _points(raw: bytes, n: int) -> np.ndarray:
    kind = np.int16 if raw[0] == 2 else np.int64
    return np.frombuffer(raw, dtype=kind, offset=1).reshape(n, -1).astype(np.int64)


def _pack(blocks: DataFrame) -> DataFrame:
    """One row for each block of (id, v, region, part), with its tree."""

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        points = matrix(table.column("v").combine_chunks(), np.int64)
        if points.shape[1]:
            both = np.unique(np.column_stack([ids, points]), axis=0)  # repeated rows are one
        else:
            both = np.unique(ids)[:, None]
        ids, points = both[:, 0], both[:, 1:]
        tree = CoverTree(points.astype(np.float64))
        nodes = tree.packed()
        ids, points = ids[tree.order], points[tree.order]
        return pa.table({
            "region": table.column("region")[:1].cast(pa.int32()),
            "part": table.column("part")[:1].cast(pa.int32()),
            "centre": pa.array([points[int(nodes[0, 0])].astype(np.float64)], pa.list_(pa.float64())),
            "radius": pa.array([nodes[0, 5]], pa.float64()),
            "ids": pa.array([ids.tobytes()], pa.binary()),
            "points": pa.array([_narrow(points)], pa.binary()),
            "nodes": pa.array([nodes.tobytes()], pa.binary()),
        })

    return blocks.groupBy("region", "part").applyInArrow(build, PACKED)


class _Side:
    def __init__(self, ids: bytes, points: bytes, nodes: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.points = _points(points, len(self.ids))
        table = np.frombuffer(nodes, np.float64).reshape(-1, 6)
        self.lo, self.hi, self.first, self.last = table[:, 1:5].astype(np.int64).T
        self.radius = table[:, 5]
        self.centre = self.points[table[:, 0].astype(np.int64)].astype(np.float64)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))


def _expanded(side: _Side, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each node, itself if a leaf: (place in ``nodes``, child)."""
    leaf = side.first[nodes] == side.last[nodes]
    n = np.where(leaf, 1, side.last[nodes] - side.first[nodes])
    of = np.repeat(np.arange(len(nodes)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return of, np.where(leaf[of], nodes[of], side.first[nodes[of]] + step)


def dual_tree(q: _Side, d: _Side, k: int, worst: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's place, best scores and ids in the block ``d``.

    ``worst`` is the score, by place of query, that others reached k times already.
    """
    worst = worst.copy()
    wide = np.abs(q.points).max(initial=0) * np.abs(d.points).max(initial=0) * max(1, q.points.shape[1])
    kind = np.float64 if wide < 2.0**53 else np.int64

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r, s = q.radius[a], d.radius[b]
        top = np.einsum("ij,ij->i", q.centre[a], d.centre[b]) + q.norm[a] * s + d.norm[b] * r + r * s
        return top + 1e-9 * np.abs(top) + 1e-6

    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        group_worst = np.array([worst[lo:hi].min() for lo, hi in zip(q.lo, q.hi)])
        top = bound(a, b)
        open_ = top >= group_worst[a]
        a, b, top = a[open_], b[open_], top[open_]
        if ((q.first[a] == q.last[a]) & (d.first[b] == d.last[b])).all():
            break
        of, a2 = _expanded(q, a)
        a, b = a2, b[of]
        of, b = _expanded(d, b)
        a = a[of]
    order = np.lexsort((-top, a))
    a, b, top = a[order], b[order], top[order]
    for leaf in np.unique(a):
        mine = slice(*np.searchsorted(a, [leaf, leaf + 1]))
        lo, hi = q.lo[leaf], q.hi[leaf]
        found = [(np.empty(0), np.empty(0, np.int64))] * (hi - lo)
        leaves, tops, at = b[mine], top[mine], 0
        while at < len(leaves):
            some = leaves[at : at + 4][tops[at : at + 4] >= worst[lo:hi].min()]
            at += 4
            if not len(some):
                break
            rows = np.concatenate([np.arange(d.lo[x], d.hi[x]) for x in some])
            scores = q.points[lo:hi].astype(kind) @ d.points[rows].astype(kind).T
            for i in range(hi - lo):
                keep = (scores[i] >= worst[lo + i]) & (d.ids[rows] != q.ids[lo + i])
                if keep.any():
                    best, ids = found[i]
                    found[i] = keep_best(np.r_[best.astype(kind), scores[i][keep]],
                                         np.r_[ids, d.ids[rows[keep]]], k)
                    if len(found[i][0]) == k:
                        worst[lo + i] = max(worst[lo + i], found[i][0][-1])
        for i, (best, ids) in enumerate(found):
            yield lo + i, best, ids


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """Each query's ``k`` best rows: query_id, rank, vec_id, score.

    Components are floor(``scale`` * x). ``is_query`` is a condition on ``rows``;
    queries are candidates for each other.
    """
    whole = usable_vectors(
        rows.select(key, vector), key, vector, lambda x: F.floor(scale * x.cast("double"))
    )
    pivots = _far_apart(sample_of(whole, SAMPLE), PIVOTS)

    def nearest(points: np.ndarray) -> np.ndarray:
        if len(pivots) < 2:
            return np.zeros(len(points))
        return ((pivots**2).sum(axis=1) - 2 * points @ pivots.T).argmin(axis=1)

    placed = with_region(whole, nearest)
    data = checkpointed(_pack(in_blocks(placed, BLOCK)))
    asked = rows.where(is_query).select(F.col(key).cast("long").alias("id")).distinct()
    wanted = placed.join(asked, "id", "left_semi")
    renamed = {c: f"q_{c}" for c in data.columns}
    queries = checkpointed(_pack(in_blocks(wanted, QUERY_BLOCK)).withColumnsRenamed(renamed))

    def find(row: dict) -> pa.RecordBatch:
        q = _Side(row["q_ids"], row["q_points"], row["q_nodes"])
        d = _Side(row["ids"], row["points"], row["nodes"])
        known = dict(zip(*[np.frombuffer(row[c] or b"", np.int64).tolist() for c in ("k_ids", "k_scores")]))
        worst = np.array([known.get(i, -np.inf) for i in q.ids.tolist()])
        out = [(q.ids[i], s, ids) for i, s, ids in dual_tree(q, d, k, worst) if len(ids)]
        columns = [np.repeat([o[0] for o in out], [len(o[2]) for o in out]).astype(np.int64),
                   np.concatenate([o[2] for o in out] or [np.empty(0)]).astype(np.int64),
                   np.concatenate([o[1] for o in out] or [np.empty(0)]).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    none = F.lit(None).cast("binary")
    home = (F.col("q_region") == F.col("region")) & (F.col("part") == 0)
    about_q = queries.select("q_region", "q_part", "q_centre", "q_radius")
    about_d = data.select("region", "part", "centre", "radius")
    first = data.where("part = 0").select("region", "part")
    pairs = about_q.select("q_region", "q_part", F.col("q_region").alias("region")).join(first, "region")
    blank = queries.withColumn("k_ids", none).withColumn("k_scores", none)
    found = checkpointed(search(pairs, blank, data, find, FOUND))

    # the k-th score that each query has so far, packed by query block
    kth = best_of(found, k).where(F.col("rank") == k).select("query_id", "score")
    of_block = queries.select("q_region", "q_part", "q_ids").mapInArrow(_ids_of, "q_region int, q_part int, query_id long")
    levels = (
        of_block.join(kth, "query_id", "left").groupBy("q_region", "q_part")
        .agg(F.sort_array(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("query_id", "score")))).alias("ks"),
             F.min(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))).alias("q_worst"))
    )
    levels = checkpointed(levels.mapInArrow(
        _packed_levels, "q_region int, q_part int, q_worst double, k_ids binary, k_scores binary"
    ))

    def product(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    q_norm, d_norm = F.sqrt(product("q_centre", "q_centre")), F.sqrt(product("centre", "centre"))
    top = (product("q_centre", "centre") + q_norm * F.col("radius") + d_norm * F.col("q_radius")
           + F.col("radius") * F.col("q_radius"))
    possible = ~home & (top + 1e-9 * F.abs(top) + 1e-6 >= F.col("q_worst"))
    described = about_q.join(levels.select("q_region", "q_part", "q_worst"), ["q_region", "q_part"])
    rest = candidate_pairs(described, about_d, possible)
    told = queries.join(levels.drop("q_worst"), ["q_region", "q_part"])
    return best_of(found.unionByName(search(rest, told, data, find, FOUND)), k)


def _ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query ids of packed blocks, a row each."""
    for batch in batches:
        for region, part, raw in zip(*[c.to_pylist() for c in batch.columns]):
            ids = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), region, np.int32)), pa.array(np.full(len(ids), part, np.int32)), pa.array(ids)],
                names=["q_region", "q_part", "query_id"],
            )


def _packed_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regions, parts, lists, worst = [batch.column(i) for i in range(4)]
        packed = [
            [np.array([r[name] for r in rows], np.int64).tobytes() for rows in lists.to_pylist()]
            for name in ("query_id", "score")
        ]
        yield pa.RecordBatch.from_arrays(
            [regions, parts, worst, *[pa.array(p, pa.binary()) for p in packed]],
            names=["q_region", "q_part", "q_worst", "k_ids", "k_scores"],
        )

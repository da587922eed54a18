"""Approximate nearest neighbours: stable projections, a kd-tree, a chi-square stop.

Vectors are projected to ``DIMS`` numbers by independent normal coefficients. The
squared projected distance of two vectors, over their squared distance, follows a
chi-square law with ``DIMS`` degrees of freedom, whatever the vectors. A search
visits candidates in the order of projected distance, verifies them on the
original vectors, and stops once the next one's squared projected distance passes
t times the squared distance of the k-th best so far, where t is the quantile for
``SURE``: a row that belongs to the answer lies beyond that with a probability of
at most 1 - ``SURE``.

Nearness is the inner product. One more component, which brings all vectors to one
norm, makes the largest inner products the smallest distances.

The top of the kd-tree splits a bounded sample of projections at medians; every row
lies in one of its leaves, however many there are, and a leaf's rows are cut to
blocks of bounded size (see ``vector_blocks``), each with a kd-tree of its own. In a
first round, queries search a block of their own leaf. Then each meets the blocks
whose box the stopping test, with the distance found so far, does not exclude.

Scores are sums of products in double precision, from the first component to the
last, of the original vectors.

Defined results: rows whose id or vector is null, or whose vector is zero or holds
a null or non-finite component, take no part; vectors shorter than the longest
count as ending in zeros; a query's own id is no candidate; rows repeated with the
same id and vector are one candidate. With fewer candidates than k all are
returned, as the test holds nothing back before k are found; an empty table gives an empty result. Only the two
named columns are read.
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

DIMS, SURE, SEED = 12, 0.97, 20_060
SAMPLE, DEPTH, LEAF = 4096, 4, 32
PACKED = ("region int, part int, low array<double>, high array<double>, ids binary, points binary, "
          "projected binary, leaves binary")  # fmt: skip
FOUND = "query_id long, vec_id long, score double"


def chi_square_cdf(x: float, dims: int) -> float:
    """Of an even number of degrees of freedom: a sum of Poisson terms."""
    if dims % 2:
        raise ValueError("an even number of projections, please")
    term, total = 1.0, 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - float(np.exp(-x / 2)) * total


def chi_square_quantile(share: float, dims: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, dims) < share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, dims) < share else (low, middle)
    return high


def _medians(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Axis and threshold of each inner node of a full kd-tree, by level: children of i are 2i+1, 2i+2."""
    splits: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for some in level:
            axis = int(some.var(axis=0).argmax()) if len(some) else 0
            at = float(np.median(some[:, axis])) if len(some) else 0.0
            splits.append((axis, at))
            side = some[:, axis] < at if len(some) else np.zeros(0, bool)
            below += [some[side], some[~side]]
        level = below
    return splits


def _kd_order(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points in kd-tree order, and the ranges of its leaves."""
    order, ends, pending = np.arange(len(points)), [], [(0, len(points))]
    while pending:
        lo, hi = pending.pop()
        if hi - lo <= LEAF:
            ends.append((lo, hi))
            continue
        some = points[order[lo:hi]]
        middle = (hi - lo) // 2
        axis = int((some.max(axis=0) - some.min(axis=0)).argmax())
        order[lo:hi] = order[lo:hi][np.argpartition(some[:, axis], middle)]
        pending += [(lo, lo + middle), (lo + middle, hi)]
    return order, np.array(sorted(ends), np.int64).reshape(-1, 2)


class Projection:
    """Normal coefficients, the same each time, over vectors brought to one norm."""

    def __init__(self, width: int, norm: float) -> None:
        self.norm2 = norm * norm
        self.a = np.random.default_rng(SEED).standard_normal((width + 1, DIMS))

    def rows(self, points: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm2 - (points**2).sum(axis=1)))
        return points @ self.a[:-1] + rest[:, None] * self.a[-1]

    def queries(self, points: np.ndarray) -> np.ndarray:
        return points @ self.a[:-1]


def _pack(blocks: DataFrame, project: Projection, query: bool) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        points = matrix(table.column("v").combine_chunks(), np.float64)
        both = np.unique(np.column_stack([ids.view(np.float64), points]).view(np.int64), axis=0)
        ids, points = both[:, 0].copy(), both[:, 1:].copy().view(np.float64)  # repeated rows are one
        projected = project.queries(points) if query else project.rows(points)
        order, leaves = _kd_order(projected)
        ids, points, projected = ids[order], points[order], projected[order]
        return pa.table({
            "region": table.column("region")[:1].cast(pa.int32()),
            "part": table.column("part")[:1].cast(pa.int32()),
            "low": pa.array([projected.min(axis=0)], pa.list_(pa.float64())),
            "high": pa.array([projected.max(axis=0)], pa.list_(pa.float64())),
            **{name: pa.array([x.tobytes()], pa.binary()) for name, x in
               (("ids", ids), ("points", points), ("projected", projected), ("leaves", leaves))},
        })

    return blocks.groupBy("region", "part").applyInArrow(build, PACKED)


def incremental(
    query: np.ndarray, image: np.ndarray, points: np.ndarray, ids: np.ndarray, projected: np.ndarray,
    leaves: np.ndarray, boxes: tuple[np.ndarray, np.ndarray], k: int, norm2: float, limit: float,
    kth: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Best (scores, ids) of one query in one block, by projected distance until the test stops it.

    ``limit`` is the chi-square quantile; ``kth`` the k-th best score found elsewhere,
    below which nothing is returned.
    """
    size2 = float(query @ query)
    rounding = 4 * len(query) * np.finfo(np.float64).eps * np.sqrt(size2 * norm2)
    outside = np.maximum(0, np.maximum(boxes[0] - image, image - boxes[1]))
    away = (outside**2).sum(axis=1)
    order = np.argsort(away, kind="stable")
    sizes = leaves[:, 1] - leaves[:, 0]
    scores, found = np.empty(0), np.empty(0, np.int64)

    def least() -> float:
        """The score that a row must reach to be of use."""
        return max(kth, scores[-1]) if len(scores) == k else kth

    def reach() -> float:
        """Squared projected distance at which the test holds."""
        if least() == -np.inf:
            return np.inf
        left = max(0.0, size2 + norm2 - 2 * least())
        return limit * left + 1e-9 * (size2 + norm2)

    at, step = 0, 8
    while at < len(order):
        some = order[at : at + step]
        some = some[away[some] <= reach()]
        if not len(some):
            break
        chosen = np.zeros(len(leaves), bool)
        chosen[some] = True
        rows = np.flatnonzero(np.repeat(chosen, sizes))
        gap = projected[rows] - image
        rows = rows[np.einsum("ij,ij->i", gap, gap) <= reach()]
        # a fast product first; the ordered sum is only needed for what may count
        rows = rows[points[rows] @ query >= least() - rounding]
        values = np.cumsum(points[rows] * query, axis=1)[:, -1] if len(rows) else np.empty(0)
        count = values >= kth
        scores, found = keep_best(np.r_[scores, values[count]], np.r_[found, ids[rows[count]]], k)
        at, step = at + step, step * 2
    return scores, found


def nearest(
    rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Each query's ``k`` nearest rows found: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``rows``; queries are candidates for each other.
    """
    whole = usable_vectors(rows.select(key, vector), key, vector, lambda x: x.cast("double"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    whole = whole.where(F.exists("v", lambda x: x != 0))
    facts = whole.agg(F.max(square), F.max(F.size("v")), F.count(F.lit(1))).first()
    if not facts[2]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    project = Projection(facts[1], float(np.sqrt(facts[0])))
    limit = chi_square_quantile(SURE, DIMS)
    splits = _medians(project.rows(sample_of(whole, SAMPLE)), DEPTH)

    def region_of(points: np.ndarray) -> np.ndarray:
        images, node = project.rows(points), np.zeros(len(points), np.int64)
        axes, marks = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        for _ in range(DEPTH):
            right = images[np.arange(len(images)), axes[node]] >= marks[node]
            node = 2 * node + 1 + right
        return node

    placed = with_region(whole, region_of)
    data = checkpointed(_pack(in_blocks(placed, BLOCK), project, False))
    asked = rows.where(is_query).select(F.col(key).cast("long").alias("id")).distinct()
    wanted = placed.join(asked, "id", "left_semi")
    packed = _pack(in_blocks(wanted, QUERY_BLOCK), project, True)
    queries = checkpointed(packed.withColumnsRenamed({c: f"q_{c}" for c in packed.columns}))

    def find(row: dict) -> pa.RecordBatch:
        q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
        q_points = np.frombuffer(row["q_points"]).reshape(len(q_ids), -1)
        q_images = np.frombuffer(row["q_projected"]).reshape(len(q_ids), -1)
        points = np.frombuffer(row["points"]).reshape(len(ids), -1)
        projected = np.frombuffer(row["projected"]).reshape(len(ids), -1)
        leaves = np.frombuffer(row["leaves"], np.int64).reshape(-1, 2)
        boxes = (np.minimum.reduceat(projected, leaves[:, 0]), np.maximum.reduceat(projected, leaves[:, 0]))
        known = dict(zip(np.frombuffer(row["k_ids"] or b"", np.int64).tolist(),
                         np.frombuffer(row["k_scores"] or b"").tolist()))
        out_q, out_id, out_score = [], [], []
        for i, query in enumerate(q_ids.tolist()):
            # one more than k: the query itself may be among them
            scores, found = incremental(q_points[i], q_images[i], points, ids, projected, leaves, boxes,
                                        k + 1, project.norm2, limit, known.get(query, -np.inf))
            others = found != query
            out_q.append(np.full(others.sum(), query))
            out_id.append(found[others])
            out_score.append(scores[others])
        columns = [np.concatenate(c) if c else np.empty(0) for c in (out_q, out_id, out_score)]
        arrays = [pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.float64))]
        return pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    none = F.lit(None).cast("binary")
    home = (F.col("q_region") == F.col("region")) & (F.col("part") == 0)
    first = data.where("part = 0").select("region", "part")
    pairs = queries.select("q_region", "q_part", F.col("q_region").alias("region")).join(first, "region")
    blank = queries.withColumn("k_ids", none).withColumn("k_scores", none)
    found = checkpointed(search(pairs, blank, data, find, FOUND))
    levels = checkpointed(_levels(queries, best_of(found, k).where(F.col("rank") == k), project.norm2))

    # squared distance between boxes against the test's reach of the block's widest query
    gaps = F.zip_with(F.zip_with("q_low", "high", lambda a, b: a - b),
                      F.zip_with("low", "q_high", lambda a, b: a - b),
                      lambda a, b: F.greatest(a, b, F.lit(0.0)))
    gap2 = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    about_q = queries.select("q_region", "q_part", "q_low", "q_high").join(
        levels.select("q_region", "q_part", "q_left"), ["q_region", "q_part"]
    )
    about_d = data.select("region", "part", "low", "high")
    reach = F.lit(limit) * F.col("q_left") * (1 + 1e-9) + 1e-6 * project.norm2
    rest = candidate_pairs(about_q, about_d, ~home & (gap2 <= reach))
    told = queries.join(levels.select("q_region", "q_part", "k_ids", "k_scores"), ["q_region", "q_part"])

    return best_of(found.unionByName(search(rest, told, data, find, FOUND)), k)


def _levels(queries: DataFrame, kth: DataFrame, norm2: float) -> DataFrame:
    """For each query block the k-th scores so far, packed, and ``q_left``: the largest
    squared distance from a query to its k-th, infinite while one has fewer."""

    def of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, part, raw, points in zip(*[c.to_pylist() for c in batch.columns]):
                ids = np.frombuffer(raw, np.int64)
                size2 = (np.frombuffer(points).reshape(len(ids), -1) ** 2).sum(axis=1)
                spots = [pa.array(np.full(len(ids), x, np.int32)) for x in (region, part)]
                yield pa.RecordBatch.from_arrays(
                    [*spots, pa.array(ids), pa.array(size2)],
                    names=["q_region", "q_part", "query_id", "size2"],
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3).to_pylist()
            ids = [np.array([r["query_id"] for r in rows], np.int64).tobytes() for rows in lists]
            scores = [np.array([r["score"] for r in rows], np.float64).tobytes() for rows in lists]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(ids, pa.binary()), pa.array(scores, pa.binary())],
                names=["q_region", "q_part", "q_left", "k_ids", "k_scores"],
            )

    spread = queries.select("q_region", "q_part", "q_ids", "q_points").mapInArrow(
        of_block, "q_region int, q_part int, query_id long, size2 double"
    )
    found = F.greatest(F.lit(0.0), F.col("size2") + norm2 - 2 * F.col("score"))
    left = F.when(F.col("score").isNull(), F.lit(float("inf"))).otherwise(found)
    known = F.when(F.col("score").isNotNull(), F.struct("query_id", "score"))
    grouped = (
        spread.join(kth.select("query_id", "score"), "query_id", "left")
        .groupBy("q_region", "q_part").agg(F.max(left).alias("q_left"), F.collect_list(known).alias("ks"))
    )
    return grouped.mapInArrow(
        packed, "q_region int, q_part int, q_left double, k_ids binary, k_scores binary"
    )

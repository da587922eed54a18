"""Vectors in blocks of bounded size, for searches by blocks of queries.

Rows are grouped by region first and then, by a hash of the id, into as many
blocks as the region's count needs; a region of equal vectors that holds a third
of all rows is many blocks. A block is one row: its vectors, packed, and what its
index says about them. Query blocks meet data blocks in an equality join over a
grid, as descriptions only; those that a bound cannot rule out then meet whole, a
data block with many query blocks at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from statline.llm.common import checkpointed

BLOCK, QUERY_BLOCK, GRID = 2048, 256, 256
AT_ONCE = 64  # query blocks that meet a data block in one task


def usable_vectors(rows: DataFrame, key: str, vector: str, component: Callable[[Column], Column]) -> DataFrame:
    """(id, v): vectors without null or non-finite components, short ones padded with zeros."""
    bad = F.exists(
        F.col(vector),
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    kept = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad).select(
        F.col(key).cast("long").alias("id"), F.transform(F.col(vector), component).alias("v")
    )
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    zero = component(F.lit(0.0))
    return kept.withColumn("v", F.concat("v", F.array_repeat(zero, F.lit(width) - F.size("v"))))


def matrix(vectors: pa.Array, dtype: type) -> np.ndarray:
    """A column of equally long arrays as rows of a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(dtype)


def sample_of(vectors: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, by hash of the id: bounded, and the same each time."""
    found = vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").collect()
    return np.array([r["v"] for r in found], dtype=np.float64)


def with_region(vectors: DataFrame, region_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``vectors`` with the number of the region that each lies in."""
    schema = vectors.select("id", "v", F.lit(0).alias("region")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regions = region_of(matrix(batch.column(1), np.float64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(regions)], names=["id", "v", "region"]
                )

    return vectors.select("id", "v").mapInArrow(run, schema)


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` of (id, v, region) with ``part``: regions cut to blocks of about ``size`` rows."""
    counts = rows.groupBy("region").count()  # as many rows as regions, a fixed number
    parts = counts.select("region", F.ceil(F.col("count") / size).cast("int").alias("parts"))
    return rows.join(F.broadcast(parts), "region").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    ).drop("parts")


def candidate_pairs(queries: DataFrame, data: DataFrame, possible: Column) -> DataFrame:
    """(q_region, q_part, region, part) of blocks for which ``possible`` holds.

    ``queries`` has a description of each query block under names that start with
    ``q_``. Each data block's description is repeated for each cell of a grid of
    query blocks, so no task holds all of either.
    """
    cells = max(1, math.ceil(queries.count() / GRID))
    cell = F.pmod(F.xxhash64("q_region", "q_part"), F.lit(cells)).cast("int")
    spread = data.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    met = queries.withColumn("cell", cell).hint("shuffle_hash").join(spread, "cell")
    return met.where(possible).select("q_region", "q_part", "region", "part")


def search(pairs: DataFrame, queries: DataFrame, data: DataFrame, find: Callable, schema: str) -> DataFrame:
    """``find(query block, data block)``, two blocks' packed columns in one dict, for every pair.

    A data block is sent to a task once for every ``AT_ONCE`` query blocks or so, and these
    pass by it one after the other; which of them go together follows from their hash.
    """
    groups = max(1, math.ceil(queries.count() / AT_ONCE))
    group = F.pmod(F.xxhash64("q_region", "q_part"), F.lit(groups)).cast("int")
    keys = ["region", "part", "q_group"]
    met = pairs.withColumn("q_group", group)
    asked = met.join(queries, ["q_region", "q_part"]).drop("q_region", "q_part")
    wanted = met.select(*keys).distinct().join(data, ["region", "part"])
    wanted = wanted.toDF(*wanted.columns)  # columns of its own, beside those of the pairs

    def run(some: pa.Table, block: pa.Table) -> pa.Table:
        if not some.num_rows or not block.num_rows:
            return nothing.empty_table()
        held = block.drop_columns(keys).to_pylist()[0]
        rows = some.drop_columns(keys)
        # one at a time: a block's packed columns are copied on the way
        parts = [find({**rows.slice(i, 1).to_pylist()[0], **held}) for i in range(rows.num_rows)]
        return pa.Table.from_batches(parts)

    nothing = to_arrow_schema(T.StructType.fromDDL(schema))
    return asked.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, schema)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (query_id, vec_id, score), ties to the smaller vec_id, with ranks."""
    from pyspark.sql import Window

    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def keep_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of flat scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= least
        scores, ids = scores[some], ids[some]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


__all__ = [
    "best_of", "candidate_pairs", "checkpointed", "in_blocks", "keep_best", "matrix",
    "sample_of", "search", "usable_vectors", "with_region",
]

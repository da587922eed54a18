"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources share ``budget`` times all words by weight; none gets more than
``most`` times its own words, and what is above goes to the others by weight until
none is above. The level that solves this rises in rounds of two sums over the
sources; only those sums reach the driver.

Curriculum: each source's weight over training time, from 0 to 1, is a line
through knots. Its integral says which part of the target is due by when. Turned
round, it gives each document the time at which the words before it, in a fixed
pseudo-random order of its source, are used up: its training position. Documents
are sorted by position across ranges.

The words before a document come from sums over hash buckets of its source, so a
source with a third of all rows is spread over as many buckets as its rows need.
Everything follows from keys and sizes: reruns agree.

Defined results: a null text has size 0; a null source is a source of its own,
after all others; documents of size 0 take nothing and have no position; a source
without words has target 0; repeated rows and null keys are documents of their
own, equal ones interchangeable. An empty table gives an empty result. Payload
columns are carried in one struct, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statline.llm.common import WORD, checkpointed

WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2.0
ROWS_A_BUCKET = 4_000

Knots = Sequence[tuple[float, float]]  # (time from 0 to 1, weight)
#: By weight: heavy sources fade, light ones grow, the middle stays and then tapers.
SCHEDULES: Mapping[int, Knots] = {
    3: ((0.0, 1.5), (1.0, 0.5)),
    1: ((0.0, 0.5), (0.6, 1.0), (1.0, 1.5)),
    2: ((0.0, 1.0), (0.8, 1.0), (1.0, 0.6)),
}


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _rank_sources(sources: DataFrame) -> DataFrame:
    """``sources`` stored, with ``rank`` from 0 by code point, null last.

    Ranges are sorted side by side; only a count for each range is gathered.
    """
    order = F.col("source").asc_nulls_last()
    ranges = checkpointed(
        sources.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    )
    counts = ranges.groupBy("part").count()  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranges.withColumn("rank", within).join(F.broadcast(offsets), "part").withColumn(
        "rank", F.col("rank") + F.col("first")
    ).drop("part", "first")


def source_targets(
    sized: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST,
) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    ranked = checkpointed(
        _rank_sources(sums).select("source", "source_size", F.get(cycle, place).alias("weight"))
    )
    cap = most * F.col("source_size")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, n_full = 0.0, -1
    while True:
        full = cap <= F.col("weight") * level
        row = ranked.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, cap)).alias("kept"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == n_full or not row["open"]:
            break
        n_full, level = row["n"], (total - (row["kept"] or 0.0)) / row["open"]
    if not (row["open"] or 0):
        level = math.inf
    wanted = cap if math.isinf(level) else F.least(cap, F.col("weight") * level)
    return ranked.withColumn("target", wanted)


def _segments(knots: Knots) -> Column:
    """The schedule's lines with the part of its integral due at each end."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole, done, rows = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        fields = {"t0": t0, "w0": w0 / whole, "slope": (w1 - w0) / whole / (t1 - t0),
                  "f0": done / whole, "f1": (done + area) / whole}
        rows.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in fields.items()]))
        done += area
    return F.array(*rows)


def time_due(part: Column, knots: Knots) -> Column:
    """The time by which ``part`` (0 to 1) of the schedule's integral is due."""
    first = F.get(F.filter(_segments(knots), lambda s: (part < s["f1"]) | (s["f1"] >= 1 - 1e-12)), F.lit(0))
    ahead = part - first["f0"]
    speed = F.sqrt(F.greatest(F.lit(0.0), F.pow(first["w0"], 2) + 2 * first["slope"] * ahead))
    step = F.when(ahead > 0, 2 * ahead / (first["w0"] + speed)).otherwise(0.0)
    return F.least(F.lit(1.0), first["t0"] + step)


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    schedules: Mapping[int, Knots] = SCHEDULES,
    budget: float = BUDGET,
    most: float = MOST,
    payload: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """What the mix takes of each document, sorted by training position if ``ordered``.

    Returns key, source, size, source_size, target (the source's), taken (words,
    repeats counted) and positions: one for each pass over the document. With
    ``payload`` the input row comes along as ``row``.
    """
    rows = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        *([F.struct("*").alias("row")] if payload else []),
    )
    sized = checkpointed(rows.select("key", "source", "size"))
    if not payload:
        rows = sized
    targets = source_targets(sized, weights, budget, most)
    buckets = max(1, math.ceil(sized.count() / ROWS_A_BUCKET))
    hashed = F.xxhash64("key", "size")

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("h", hashed).withColumn("bucket", F.pmod("h", F.lit(buckets)))

    same = Window.partitionBy("source").orderBy("bucket")
    firsts = (
        bucketed(sized).groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(same) - F.col("words"))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                "before", "source_size", "weight", "target")
    )
    within = Window.partitionBy("source", "bucket").orderBy("h", "key", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = (
        bucketed(rows)
        .join(firsts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    )
    full = F.floor(F.col("target") / F.col("source_size"))
    rest = F.floor(F.col("target") - full * F.col("source_size") + 0.5)
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    placed = placed.withColumn("full", F.when(F.col("source_size") > 0, full).otherwise(0))
    taken = F.when(F.col("size") > 0, F.col("full") * F.col("size") + part).otherwise(0)
    placed = placed.withColumn("taken", taken.cast("long"))
    passes = F.ceil(F.col("taken") / F.col("size"))

    def due(n: Column) -> Column:
        share = (n * F.col("source_size") + F.col("start")) / F.col("target")
        when = F.lit(None).cast("double")
        for weight, knots in schedules.items():
            when = F.when(F.col("weight") == float(weight), time_due(share, knots)).otherwise(when)
        return when

    positions = F.when(
        F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), passes - 1), due)
    )
    mixed = placed.select(
        F.col("key").alias(key), "source", "size", "source_size", "target", "taken",
        positions.alias("positions"), *(["row"] if payload else []),
    ).withColumn("position", F.get("positions", F.lit(0)))
    return mixed.orderBy(F.col("position").asc_nulls_last(), key) if ordered else mixed


def training_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` as the mix trains on them: one for each pass, by position."""
    mixed = mix(docs, payload=True, ordered=False, **options)
    passes = mixed.where("taken > 0").select("row", F.explode("positions").alias("position"))
    return passes.orderBy("position").select("row.*")

"""Joins that stay even where one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
SALT = "join salt"


def salted_join(
    rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """``rows`` joined with a much smaller ``side`` on ``keys``, inner or left.

    Rows of one key go to ``salts`` places by their hash, and each row of ``side`` is
    there once for each. So a key with most rows is no single task's work, whatever
    needs the join's output and keeps adaptive execution from splitting it. Where
    ``side`` is small enough to be broadcast nothing is shuffled at all.
    """
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int")
    spread = side.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(SALT, salt).join(spread, [*keys, SALT], how).drop(SALT)

"""Rating-card jobs: one position's ratings laid out by age."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline import constants as K
from statline.functions.exprs import any_of, may_be

PLAYER = ("lastname", "firstname", "retroid")


def position_slots(
    cards: DataFrame, pos: str, min_year: int = K.FIRST_FIVE_POINT_SEASON
) -> DataFrame:
    """Ratings at ``pos`` from any of a card's position slots.

    A card naming the position twice gives two rows; a rating that is no number is
    NULL. The slot test is repeated on the whole card so that it can reach the scan;
    where texts are trimmed at load, a range of the stored ones does.
    """
    slots = range(1, K.CARD_SLOTS + 1)
    listed = any_of(F.col(f"pos{i}") == pos for i in slots)
    in_range = any_of(may_be(cards, f"pos{i}", pos) for i in slots)
    pairs = F.array(
        *[F.struct(F.col(f"pos{i}").alias("pos"), F.col(f"rg{i}").alias("rating")) for i in slots]
    )
    return (
        cards.where((F.col("year") >= min_year) & in_range & listed)
        .select(*PLAYER, "age", F.inline(F.filter(pairs, lambda p: p["pos"] == pos)))
        .select(*PLAYER, "age", F.col("rating").try_cast("double").alias("rg"))
    )


def pivot_by_age(ratings: DataFrame, ages: Iterable[int] = K.REPORT_AGES) -> DataFrame:
    """Best (lowest) rating per player in one column per age.

    Conditional minima need one shuffle where a pivot needs two. Players with
    no listed age stay, with NULLs throughout.
    """
    return ratings.groupBy(*PLAYER).agg(
        *[F.min(F.when(F.col("age") == age, F.col("rg"))).alias(str(age)) for age in ages]
    )

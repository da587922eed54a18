"""The rating-by-age report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from statline import constants as K
from statline.operators.ratings import pivot_by_age, position_slots


def range_by_age(
    cards: DataFrame, pos: str, min_year: int = K.FIRST_FIVE_POINT_SEASON
) -> DataFrame:
    """Each player's ratings at ``pos``, one column per age, sorted by player id."""
    return pivot_by_age(position_slots(cards, pos, min_year)).orderBy("retroid")

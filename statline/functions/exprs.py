"""Small Column builders. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.constants import LEFT_HANDER_MARK, THIRD_CORRECTION


SEASON_PARTITION = "season partition"  # a loader's name for the season in stored files' paths


def is_true(column: str) -> Column:
    """A 'T'/'F' flag as a predicate; NULL counts as not set when summed."""
    return F.col(column) == "T"


def one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_blank(column: Column | str) -> Column:
    """Empty once trailing blanks are ignored (NULL stays NULL)."""
    return F.rtrim(column) == ""


def stored_text(column: str) -> str:
    """A loader's name for a text column as its source holds it, trailing blanks and all."""
    return f"{column} as stored"


def may_be(df: DataFrame, column: str, value: str) -> Column:
    """True where a trimmed text column can equal ``value``: a range that can reach the files.

    Texts equal but for trailing blanks lie from ``value`` up to ``value`` and the
    character behind the blank. Always true where the loader left no stored text.
    """
    stored = stored_text(column)
    if stored not in df.columns:
        return F.lit(True)
    return (F.col(stored) >= value) & (F.col(stored) < value + chr(ord(" ") + 1))


def has_id(column: Column | str) -> Column:
    """True for a person id that is neither NULL nor blank."""
    return F.coalesce(F.trim(column) != "", F.lit(False))


def season_of(game_id: str = "game_id") -> Column:
    """Season inside a game id: three letters of home code, then the date."""
    return F.substring(game_id, 4, 4)


def fielding_team() -> Column:
    """Team in the field: the visitors while the home side bats."""
    return F.when(F.col("bat_home_id") == 1, F.col("away_team_id")).otherwise(
        F.substring("game_id", 1, 3)
    )


def non_negative(column: Column | str) -> Column:
    """A recorded count; missing (NULL or negative) becomes zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column > 0, column).otherwise(0)


def innings(notation: Column) -> Column:
    """Innings in .1/.2 outs notation to decimal innings, exactly."""
    out = notation
    tenths = notation % 1
    for mark, correction in THIRD_CORRECTION.items():
        add = F.lit(Decimal(correction))
        out = F.when(tenths == F.lit(Decimal(mark)), notation + add).otherwise(out)
    return out.cast("decimal(20,2)")


def is_left_hander(name: str = "name") -> Column:
    return F.endswith(F.col(name), F.lit(LEFT_HANDER_MARK))

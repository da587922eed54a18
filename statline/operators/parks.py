"""Park effects from game logs and park dimensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline import constants as K
from statline.functions.formulas import ratio
from statline.operators.team_totals import game_sides, keyed

REACH = max(map(abs, K.NEIGHBOUR_OFFSETS))  # seasons that count as neighbours, on either side
CLUB = ("YearID", "Lg", "Tm")  # Tm is the game-log team code here
HOME_ROAD = tuple(f"{stat}_{side}" for side in ("home", "road") for stat in ("games", "runs", "hr"))


def _side_sums(at_home: Column, games: Column) -> list[Column]:
    """Games, runs and home runs on each side; NULL when a side is absent."""
    sums = []
    for side, here in (("home", at_home), ("road", ~at_home)):

        def both(a: str, b: str, here: Column = here) -> Column:
            return F.sum(F.when(here, F.col(a))) + F.sum(F.when(here, F.col(b)))

        sums += [
            F.sum(F.when(here, games)).alias(f"games_{side}"),
            both("homscore", "visscore").alias(f"runs_{side}"),
            both("homhr", "vishr").alias(f"hr_{side}"),
        ]
    return sums


def _filled() -> list[Column]:
    """Missing sums as zero; a road record needs the whole key to be matched."""
    matched = F.col("Lg").isNotNull() & F.col("Tm").isNotNull() & F.col("YearID").isNotNull()
    home = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in HOME_ROAD[:3]]
    road = [F.coalesce(F.when(matched, F.col(c)), F.lit(0)).alias(c) for c in HOME_ROAD[3:]]
    return home + road


def home_road_stats(sides: DataFrame) -> DataFrame:
    """Home and road games, runs, home runs for every club with a home game."""
    return (
        sides.groupBy(F.col("Year").alias("YearID"), "Lg", F.col("retro").alias("Tm"))
        .agg(*_side_sums(F.col("at_home"), F.col("games")))
        .where(F.col("games_home").isNotNull())
        .select(*CLUB, *_filled())
    )


def park_stats(gamelogs: DataFrame) -> DataFrame:
    """As :func:`home_road_stats`, summing the home side park by park."""
    at_home = F.col("at_home")
    per_park = (
        game_sides(gamelogs)
        .groupBy(
            F.col("Year").alias("YearID"), "Lg", F.col("retro").alias("Tm"),
            at_home, F.when(at_home, F.col("parkid")).alias("parkid"),
        )
        .agg(*_side_sums(at_home, F.lit(1)))
    )
    per_park = per_park.select(
        *CLUB, "at_home", "games_home",
        *[F.when(at_home, F.coalesce(c, F.lit(0))).alias(c) for c in HOME_ROAD[1:3]],
        *HOME_ROAD[3:],
    )
    return (
        per_park.groupBy(*CLUB)
        .agg(*[F.sum(c).alias(c) for c in HOME_ROAD])
        .where(F.col("games_home").isNotNull())
        .select(*CLUB, *_filled())
    )


def _to_neighbours(year: str) -> Column:
    """One row for each season this one is a neighbour of."""
    return F.explode(F.array(*[F.col(year) + F.lit(d) for d in K.NEIGHBOUR_OFFSETS]))


def comparable_park_years(parkconfig: DataFrame) -> DataFrame:
    """Each park-season with the near seasons in which it measured the same.

    Seasons without one keep a single row with ``years_ext`` NULL. The +-2
    year range becomes an equality on a fanned-out year, so this is a hash or
    merge join on park, dimensions and year.
    """
    same = ["parkid", *K.PARK_DIMENSIONS]
    base = parkconfig.select(
        F.col("year").alias("year_base"), "retrotm", "lg", *same,
        _to_neighbours("year").alias("years_ext"),
    )
    ext = parkconfig.select(F.col("year").alias("years_ext"), *same)
    # a base row with no partner at all is kept once, not once per offset
    met = base.join(ext, ["years_ext", *same]).select(
        "year_base", "parkid", "retrotm", "lg", "years_ext", *K.PARK_DIMENSIONS
    )
    seen = met.select(F.col("year_base").alias("year"), *same).distinct()
    alone = parkconfig.join(seen, ["year", *same], "left_anti").select(
        F.col("year").alias("year_base"), "parkid", "retrotm", "lg",
        F.lit(None).cast("int").alias("years_ext"),
    )
    return met.drop(*K.PARK_DIMENSIONS).unionByName(alone)


def park_seasons(parkconfig: DataFrame) -> DataFrame:
    """How many rows each park has by season, club and dimensions: all that counts need."""
    same = ["parkid", *K.PARK_DIMENSIONS]
    return (
        keyed(parkconfig, "year", *same)
        .groupBy("year", "retrotm", *same)
        .agg(F.count(F.lit(1)).alias("parks"))
    )


def vouching_counts(seasons: DataFrame) -> DataFrame:
    """How many comparable park-seasons vouch for a club's season, from :func:`park_seasons`."""
    same = ["parkid", *K.PARK_DIMENSIONS]
    base = keyed(seasons, "retrotm").select(
        "retrotm", *same, F.col("parks").alias("bases"), _to_neighbours("year").alias("YearID")
    )
    ext = seasons.groupBy(F.col("year").alias("YearID"), *same).agg(F.sum("parks").alias("exts"))
    return (
        base.join(ext, ["YearID", *same])
        .groupBy("YearID", F.col("retrotm").alias("Tm"))
        .agg(F.sum(F.col("bases") * F.col("exts")).alias("n"))
    )


def comparable_counts(parkconfig: DataFrame) -> DataFrame:
    """As :func:`vouching_counts`, from the dimensions themselves.

    Same as counting :func:`comparable_park_years` by (years_ext, retrotm), but
    both sides are counted before they meet, so no pair is ever produced.
    """
    return vouching_counts(park_seasons(parkconfig))


def neighbour_season_sums(stats: DataFrame) -> DataFrame:
    """Sums over the club's other seasons within two years, whatever the league.

    One row per club and season that has a neighbour. Each season is sent to
    the seasons it borders and summed there: map-side combining instead of a
    sorted frame over a whole club history.
    """
    return (
        keyed(stats, "YearID", "Tm")
        .select("Tm", *HOME_ROAD, _to_neighbours("YearID").alias("YearID"))
        .groupBy("YearID", "Tm")
        .agg(*[F.sum(c).alias(c) for c in HOME_ROAD])
    )


def seasons_with_neighbours(stats: DataFrame) -> DataFrame:
    """Each club-season with its :func:`neighbour_season_sums`, NULL for none."""
    near = neighbour_season_sums(stats).select(
        "YearID", "Tm", *[F.col(c).alias(f"near_{c}") for c in HOME_ROAD]
    )
    return stats.join(near, ["YearID", "Tm"], "left")


def park_factors(sides: DataFrame, parkconfig: DataFrame) -> DataFrame:
    """As :func:`factors_from_counts`, from the dimensions themselves."""
    return factors_from_counts(sides, comparable_counts(parkconfig))


def factors_from_counts(sides: DataFrame, comparable: DataFrame) -> DataFrame:
    """Run and home-run factors of a club's home games.

    Early seasons use padded per-game rates; seasons without a comparable
    park-season their own rates; all others weigh their own season by the
    number of comparable ones and add the neighbouring seasons.
    """
    # a season without a league is a neighbour, too, but has no factor of its own
    clubs = keyed(seasons_with_neighbours(home_road_stats(sides)), *CLUB)
    board = clubs.join(comparable, ["YearID", "Tm"], "left")
    counts = [*HOME_ROAD, *[f"near_{c}" for c in HOME_ROAD]]
    board = board.selectExpr(
        *CLUB, "games_home AS home", "double(coalesce(n, 0)) AS n",
        *[f"double({c}) AS {c}" for c in counts],
    )

    def padded(stat: str, side: str) -> str:
        return ratio(f"{stat}_{side} + {K.PADDED_COUNT}", f"games_{side} + {K.PADDED_GAMES}")

    def single(stat: str, side: str) -> str:
        return ratio(f"{stat}_{side}", f"games_{side}")

    def weighted(stat: str, side: str) -> str:
        own, games = f"{stat}_{side}", f"games_{side}"
        return ratio(f"n * {own} + near_{own}", f"n * {games} + near_{games}")

    def factor(stat: str, name: str) -> str:
        def over(rate: Callable[[str, str], str]) -> str:
            return ratio(rate(stat, "home"), rate(stat, "road"))

        return (
            f"CASE WHEN YearID < {K.FIRST_FULL_RECORD_SEASON} THEN {over(padded)} "
            f"WHEN n = 0 THEN {over(single)} ELSE {over(weighted)} END AS {name}"
        )

    return board.selectExpr(
        *CLUB,
        "home AS games_home",
        factor("runs", "park_run_factor"),
        factor("hr", "park_hr_factor"),
    )

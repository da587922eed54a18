"""Team-season totals: batting, pitching, fielding, and game-log counts.

Player and game rows are always summed to team-seasons before any join, so
joins only ever see small aggregated sides and Spark picks their strategy by
measured size; nothing is force-broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline import constants as K
from statline.functions.exprs import innings, is_left_hander, non_negative
from statline.functions.formulas import ratio

TEAM = ("Year", "Lg", "Tm")
LEAGUE = ("Year", "Lg")

BATTING_STATS = ("AB", "R", "H", "2B", "3B", "HR", "BB", "SO", "HBP", "SH", "SF", "SB", "CS")


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with every key present; the others could never meet a join."""
    return df.dropna(subset=list(keys))


def renamed(df: DataFrame, *names: str) -> list[Column]:
    """Columns under report spelling (sources spell them in lower case)."""
    return [F.col(f"`{n}`").alias(n) for n in names]


def one_team(df: DataFrame) -> DataFrame:
    """Drop the rows that sum a player's several teams."""
    return df.where(F.col("tm") != K.MULTI_TEAM)


# --------------------------------------------------------------------------
# batting and pitching
# --------------------------------------------------------------------------


def team_batting(batting: DataFrame) -> DataFrame:
    return (
        one_team(batting)
        .select(*renamed(batting, *TEAM, *BATTING_STATS))
        .groupBy(*TEAM)
        .agg(*[F.sum(f"`{s}`").alias(s) for s in BATTING_STATS])
    )


def pitching_team_seasons(pitching: DataFrame) -> DataFrame:
    """Every pitching sum any job needs, per team-season, multi-team rows included.

    One pass over player-seasons; the jobs below are projections of it.
    """
    ip = innings(F.col("ip"))
    left = is_left_hander()
    return pitching.groupBy(*[F.col(k.lower()).alias(k) for k in TEAM]).agg(
        *[F.sum(s.lower()).alias(s) for s in ("W", "L", "BF")],
        F.sum(ip).alias("IP"),
        *[F.sum(s.lower()).alias(s) for s in ("H", "R", "ER", "HR")],
        F.sum(F.coalesce("hbp", F.lit(0))).alias("HBP"),
        *[F.sum(s.lower()).alias(s) for s in ("BB", "SO", "WP", "BK")],
        F.sum(F.when(left, ip).otherwise(0)).alias("IP_LHP"),
        F.sum(F.when(left, F.col("so")).otherwise(0)).alias("SO_LHP"),
        F.sum("gs").alias("GS"),
    )


def team_innings(pitching_totals: DataFrame) -> DataFrame:
    """Decimal innings per team-season."""
    return pitching_totals.where(F.col("Tm") != K.MULTI_TEAM).select(*TEAM, "IP")


def left_hander_split(pitching_totals: DataFrame) -> DataFrame:
    """Innings and strikeouts by left-handed pitchers per team-season."""
    return pitching_totals.where(F.col("Tm") != K.MULTI_TEAM).select(*TEAM, "IP_LHP", "SO_LHP")


def team_starts(pitching_totals: DataFrame) -> DataFrame:
    """Games started, hence played, per team-season."""
    return pitching_totals.where(F.col("Tm") != K.MULTI_TEAM).select(*TEAM, "GS")


def team_pitching(pitching_totals: DataFrame, sacrifices: DataFrame) -> DataFrame:
    """Pitching totals with opponents' sacrifices, for teams found in game logs."""
    return pitching_totals.join(sacrifices, list(TEAM)).select(
        *TEAM,
        "W",
        "L",
        F.expr(ratio("double(W)", "double(W + L)")).alias("WPCT"),
        "BF", "IP", "H", "R", "ER", "HR", "SH", "SF", "HBP", "BB", "SO", "WP", "BK",
        "IP_LHP", "SO_LHP",
    )


# --------------------------------------------------------------------------
# game logs
# --------------------------------------------------------------------------

SIDE_COUNTS = ("opp_sh", "opp_sf", "own_dp", "home_win", "homscore", "visscore", "homhr", "vishr")


def game_sides(gamelogs: DataFrame) -> DataFrame:
    """Two rows per game, one from each team's point of view."""
    home_win = F.when(F.col("homscore") > F.col("visscore"), 1).otherwise(0)

    def side(own: str, opp: str, at_home: bool) -> Column:
        return F.struct(
            F.lit(at_home).alias("at_home"),
            F.col(f"{own}league").alias("Lg"),
            F.col(f"{own}team").alias("retro"),
            non_negative(f"{opp}sh").alias("opp_sh"),
            non_negative(f"{opp}sf").alias("opp_sf"),
            non_negative(f"{own}dp").alias("own_dp"),
        )

    return gamelogs.select(
        F.substring("yyyymmdd", 1, 4).cast("int").alias("Year"),
        F.col("homleague").alias("home_lg"),
        "parkid",
        home_win.alias("home_win"),
        "homscore", "visscore", "homhr", "vishr",
        F.inline(F.array(side("hom", "vis", True), side("vis", "hom", False))),
    )


def side_totals(gamelogs: DataFrame) -> DataFrame:
    """Game-log sums per team-season, side and host league, in one pass.

    Small whatever the number of games; every team-season count from game
    logs is a further sum of these rows.
    """
    return (
        game_sides(gamelogs)
        .groupBy("Year", "home_lg", "Lg", "retro", "at_home")
        .agg(F.count(F.lit(1)).alias("games"), *[F.sum(c).alias(c) for c in SIDE_COUNTS])
    )


def with_br_code(sides: DataFrame, teams: DataFrame) -> DataFrame:
    """Add ``Tm``, the season tables' code for a game-log team."""
    codes = teams.select(
        F.col("yearid").alias("Year"),
        F.col("lgid").alias("Lg"),
        F.col("teamidretro").alias("retro"),
        F.col("teamidbr").alias("Tm"),
    )
    return sides.join(codes, ["Year", "Lg", "retro"])


def opponent_sacrifices(sides: DataFrame, teams: DataFrame) -> DataFrame:
    """Sacrifices a team's pitchers gave up, from the other side's counts."""
    by_code = sides.groupBy("Year", "Lg", "retro").agg(
        F.sum("opp_sh").alias("SH"), F.sum("opp_sf").alias("SF")
    )
    return (
        with_br_code(by_code, teams)
        .groupBy(*TEAM)
        .agg(F.sum("SH").alias("SH"), F.sum("SF").alias("SF"))
    )


def team_double_plays(sides: DataFrame, teams: DataFrame) -> DataFrame:
    """Double plays turned, for teams with both home and road games."""
    by_code = sides.groupBy("Year", "Lg", "retro").agg(
        F.sum("own_dp").alias("DP"),
        F.max("at_home").alias("home"),
        F.max(~F.col("at_home")).alias("road"),
    )
    return (
        with_br_code(by_code, teams)
        .groupBy(*TEAM)
        .agg(F.sum("DP").alias("DP"), F.max("home").alias("home"), F.max("road").alias("road"))
        .where("home AND road")
        .select(*TEAM, "DP")
    )


def home_wins_road_losses(sides: DataFrame, teams: DataFrame) -> DataFrame:
    """Home wins and road losses.

    A road loss belongs to the host's league, so one suffered across leagues
    finds no home record of that team there and drops out.
    """
    by_code = sides.groupBy("Year", "Lg", "home_lg", "retro", "at_home").agg(
        F.sum("home_win").alias("home_win")
    )
    at_home = F.col("at_home")
    return (
        keyed(with_br_code(by_code, teams), "home_lg", "Tm")
        .groupBy("Year", F.col("home_lg").alias("Lg"), "Tm")
        .agg(
            F.sum(F.when(at_home, F.col("home_win"))).alias("W_HOME"),
            F.sum(F.when(~at_home, F.col("home_win"))).alias("L_ROAD"),
        )
        .dropna(subset=["W_HOME", "L_ROAD"])
    )


# --------------------------------------------------------------------------
# fielding
# --------------------------------------------------------------------------


def fielding_team_seasons(fielding: DataFrame) -> DataFrame:
    """Sums per team-season and position, one row per team-season.

    ``fielding`` holds all positions with a ``pos`` tag. ``n_<pos>`` counts
    rows at a position, so that a team missing one can be told from zeros.
    Player rows are summed by team and position, one sum for each statistic;
    positions become columns on the few rows that leaves.
    """
    stats = [s.lower() for s in (*K.FIELDING_STATS, *K.CATCHER_STATS)]
    by_position = (
        keyed(one_team(fielding), "year", "lg")
        .groupBy(*[F.col(k.lower()).alias(k) for k in TEAM], "pos")
        .agg(*[F.sum(s).alias(s) for s in stats], F.count(F.lit(1)).alias("n"))
    )
    # a row for each team and position is left: at most one value in each column below
    wide = []
    for column in positional_columns():
        stat, tag = column.split("_")
        wide.append(f"sum(CASE WHEN pos = '{tag.lower()}' THEN {stat.lower()} END) AS {column}")
    wide += [f"sum(CASE WHEN pos = '{p}' THEN n ELSE 0 END) AS n_{p.upper()}" for p in K.POSITIONS]
    return by_position.groupBy(*TEAM).agg(*map(F.expr, wide))


def positional_columns() -> list[str]:
    """Sum columns of :func:`fielding_team_seasons`."""
    return [
        f"{s}_{pos.upper()}"
        for pos in K.POSITIONS
        for s in K.FIELDING_STATS + (K.CATCHER_STATS if pos == "c" else ())
    ]


def has_all_positions() -> str:
    return " AND ".join(f"n_{pos.upper()} > 0" for pos in K.POSITIONS)


def team_fielding_totals(
    fielding_totals: DataFrame, double_plays: DataFrame, by_position: bool = False
) -> DataFrame:
    """Putouts, assists, errors over all positions, passed balls, double plays.

    ``by_position`` carries the positional sums along.
    """

    def across(stat: str) -> str:
        return " + ".join(f"{stat}_{pos.upper()}" for pos in K.POSITIONS) + f" AS {stat}"

    carried = positional_columns() if by_position else []
    return (
        fielding_totals.where(has_all_positions())
        .selectExpr(*TEAM, *map(across, ("PO", "A", "E")), "PB_C AS PB", *carried)
        .join(double_plays, list(TEAM))
    )

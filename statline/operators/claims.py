"""Player claim points and the final player shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline import constants as K
from statline.functions.formulas import ratio, rounded
from statline.functions.joins import salted_join
from statline.operators.team_totals import TEAM, has_all_positions
from statline.operators.win_shares import share_column

CLAIM_PLACES = 6  # claim points keep this many decimals, so that sums are exact
ROW = ("Year", "Lg", "Tm", "Pos")
RANGE_POSITIONS = tuple(p for p, w in K.CLAIM_WEIGHTS.items() if "RBP" in w)


def _by_position(values: dict[str, str]) -> str:
    return "CASE Pos " + " ".join(f"WHEN '{p}' THEN {v}" for p, v in values.items()) + " END"


def range_bonus_plays() -> str:
    """Plays made beyond the team's rate at the position, not below zero."""
    rates = {}
    for pos in RANGE_POSITIONS:
        chances = f"double(PO_{pos.upper()} + A_{pos.upper()})"
        fielders = f"{K.OUTFIELDERS} * " if pos == "of" else ""
        rates[pos] = ratio(chances, f"{fielders}double(IP)")
    extra = f"({ratio('double(PO + A)', 'double(Inn)')} - {_by_position(rates)}) * Inn"
    return f"CASE WHEN Inn > 0 AND {extra} > 0 THEN {extra} ELSE 0D END"


def claim_value() -> str:
    """Weighted plays of a row by its position's weights."""
    return _by_position(
        {
            pos: " + ".join(f"({weight}) * {stat}" for stat, weight in weights.items()) + " + 0D"
            for pos, weights in K.CLAIM_WEIGHTS.items()
        }
    )


def claim_points(
    fielding: DataFrame, fielding_totals: DataFrame, team_pitching: DataFrame
) -> DataFrame:
    """Claim points of every fielder in a major league since 1901.

    Catchers need a team pitching record, infielders beyond first base and
    outfielders also a team record at every position; first basemen need
    neither. One left join to the combined team row answers all three; a team with
    most of the rows is spread over many tasks.
    """
    chances = [f"{s}_{p.upper()}" for p in RANGE_POSITIONS for s in ("PO", "A")]
    fielded = fielding_totals.where(F.col("Lg") != K.MULTI_LEAGUE).where(has_all_positions())
    team = team_pitching.selectExpr(*TEAM, "IP", "true AS pitched").join(
        fielded.selectExpr(*TEAM, *chances, "true AS fielded"), list(TEAM), "left"
    )
    rows = fielding.where(
        F.col("pos").isin(*K.SHARE_POSITIONS)
        & F.col("lg").isin(*K.MAJOR_LEAGUES)
        & (F.col("year") >= K.FIRST_MODERN_SEASON)
    ).selectExpr(
        "year AS Year", "lg AS Lg", "tm AS Tm", "pos AS Pos",
        "name AS Name", "`name-additional` AS BBRefID",
        *[f"{s.lower()} AS {s}" for s in ("Inn", "PO", "A", "E", "DP")],
        *[f"CASE WHEN pos = 'c' THEN {s.lower()} END AS {s}" for s in K.CATCHER_STATS],
    )
    eligible = _by_position(
        {"1b": "true", "c": "pitched"} | dict.fromkeys(RANGE_POSITIONS, "fielded")
    )
    points = f"CASE WHEN Inn > 0 AND value > 0 THEN {rounded('value', CLAIM_PLACES)} ELSE 0D END"
    return (
        salted_join(rows, team, TEAM, "left")
        .where(eligible)
        .selectExpr("*", f"{range_bonus_plays()} AS RBP")
        .selectExpr("*", f"{claim_value()} AS value")
        .selectExpr(
            *ROW, "Name", "BBRefID", "Inn", "PO", "A", "E", "DP", *K.CATCHER_STATS,
            f"{points} AS ClaimPoints",
        )
    )


def fielding_shares(claims: DataFrame, team_shares: DataFrame, starts: DataFrame) -> DataFrame:
    """Each player's part of the wins credited to his team at his position.

    Position totals are aggregated and joined with the team rows first; the
    player rows then meet one small side, in one join that spreads hot keys. A
    window over each team's players would not. ``claims`` is read twice.
    """
    unit = 10**CLAIM_PLACES
    # claim points as whole units: their sums do not depend on order
    units = F.expr(f"sum(cast(round(ClaimPoints * {unit}) AS decimal(28,0)))")
    totals = claims.groupBy(*ROW).agg(units.alias("units"))
    wins = ", ".join(
        f"struct('{p}' AS Pos, `{share_column(p)}` AS wins)" for p in K.SHARE_POSITIONS
    )
    pool = (
        team_shares.selectExpr(*TEAM, f"inline(array({wins}))")
        .join(totals, list(ROW))
        .join(starts, list(TEAM))
        .selectExpr(*ROW, "wins", "double(GS) AS GS", f"double(units) / {unit} AS pool")
    )
    season, inn = K.SCHEDULE_GAMES, "double(CASE WHEN Inn > 0 THEN Inn ELSE 1 END)"
    return (
        salted_join(claims, pool, ROW)
        .selectExpr("*", f"{ratio('ClaimPoints', 'pool')} * wins AS FWS")
        .selectExpr(
            "Year", "Lg", "Tm", "Name", "Pos", "BBRefID", "Inn",
            f"{ratio(f'double(Inn) * {season}', 'GS')} AS Inn_adj",
            "FWS",
            f"{ratio(f'FWS * {season}', 'GS')} AS FWSadj",
            f"{ratio('FWS', inn)} * {K.SEASON_INNINGS} AS `FWS/1458`",
        )
    )

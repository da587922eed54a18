"""The standard pitching report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline.functions.formulas import fixed_point, half_up_ratio
from statline.operators.pitching import (
    ALL_METRICS,
    SPLIT_METRICS,
    Bound,
    events_in_years,
    game_lines,
    game_log_decisions,
    games_pitched,
    pitcher_lines,
    runs_allowed,
    season_lines,
)
from statline.sources.tables import Tables

KEYS = ["Year", "Team", "RetroID"]


def _total_bases(sfx: str) -> str:
    return f"H{sfx} + DB{sfx} + 2 * TP{sfx} + 3 * HR{sfx}"


def _rates(sfx: str) -> list[str]:
    """Average, on-base and slugging to three places."""
    reached = f"H{sfx} + BB{sfx} + HBP{sfx}"
    chances = f"AB{sfx} + BB{sfx} + HBP{sfx} + SF{sfx}"
    return [
        f"{half_up_ratio(f'H{sfx}', f'AB{sfx}', 5, 3)} AS AVG{sfx}",
        f"{half_up_ratio(reached, chances, 5, 3)} AS OBP{sfx}",
        f"{half_up_ratio(_total_bases(sfx), f'AB{sfx}', 5, 3)} AS SLG{sfx}",
    ]


def _split(sfx: str) -> list[str]:
    before = [f"{s}{sfx}" for s in ("PA", "AB", "H", "DB", "TP", "HR", "RBI", "BB", "SO")]
    after = [f"{s}{sfx}" for s in ("GDP", "HBP", "SH", "SF", "IBB")]
    return [*_rates(sfx), *before, f"{_total_bases(sfx)} AS TB{sfx}", *after]


def _report_columns() -> list[str]:
    # outs notation: whole innings, then the outs left over; no limit on length
    innings = fixed_point("10 * (Outs div 3) + Outs % 3", 18, 1)
    # unknown for a pitcher charged with no run, earned or not
    era_known = "pitched AND charged"
    return [
        "Year", "Team", "name_last", "name_first", "RetroID",
        "G", "GS", "Outs", f"{innings} AS IP", "R", "ER",
        f"CASE WHEN {era_known} THEN {half_up_ratio('27 * ER', 'Outs', 8, 2)} END AS ERA",
        f"coalesce({era_known} AND no_outs AND ER > 0, false) AS ERA_is_inf",
        "W", "L", "SV",
        "PA", "AB", "H", "DB", "TP", "HR", "RBI", "SB", "CS", "BB", "SO",
        *_rates(""), f"{_total_bases('')} AS TB", "GDP", "HBP", "SH", "SF", "IBB",
        "'' AS PlatoonStats",
        f"{half_up_ratio('100 * PA_L', 'PA', 3, 0)} AS PctVsLHP",
        *_split("_L"),
        *_split("_R"),
        "'' AS Baserunning",
        # a second copy sits with the running game; names must differ to be stored
        "SB AS SB_run", "CS AS CS_run",
        f"{half_up_ratio('100 * SB', 'SB + CS', 5, 1)} AS SBPct",
        "SBO",
        f"{half_up_ratio('100 * (SB + CS)', 'SBO', 6, 2)} AS JumpPct",
        "SB2", "CS2", "SB3", "CS3", "SBH", "CSH", "PkO", "POCS",
    ]


def _lines_of_three_scans(plays: DataFrame, pickoff_mode: str) -> DataFrame:
    """Counts by the pitcher responsible, runs by the pitcher charged, and distinct games.

    Each reads only its own columns. All three end up hashed on the same three keys, so
    joining them moves no row again.
    """
    lines = pitcher_lines(plays, pickoff_mode).withColumn("pitched", F.lit(True))
    runs = runs_allowed(plays).withColumn("charged", F.lit(True))
    return games_pitched(plays).join(lines, KEYS, "left").join(runs, KEYS, "left")


def standard_pitching(
    tables: Tables,
    start: Bound = None,
    end: Bound = None,
    pickoff_mode: str = "as_caught",
    one_scan: bool = False,
) -> DataFrame:
    """One line per pitcher, team and season in ``start``..``end``, by default all, sorted.

    By default plays are read three times, a few columns each. With ``one_scan`` they are
    read once, into sums by game and pitcher that all three kinds of count come from:
    that shuffles wider rows, some for each game, and pays where reading plays is dear.
    """
    plays = events_in_years(tables.events, start, end)
    if one_scan:
        lines = season_lines(game_lines(plays, pickoff_mode))
    else:
        lines = _lines_of_three_scans(plays, pickoff_mode)
    decisions = game_log_decisions(tables.gamelogs, start, end)
    people = tables.people.where("name_last IS NOT NULL").selectExpr(
        "key_retro AS RetroID", "name_last", "name_first"
    )
    counts = [
        *ALL_METRICS,
        *[f"{m}_{hand}" for m in SPLIT_METRICS for hand in "LR"],
        "SB", "CS", "SB2", "SB3", "SBH", "CS2", "CS3", "CSH", "PkO", "POCS", "SBO",
        "R", "ER", "GS", "W", "L", "SV",
    ]
    board = (
        lines.join(decisions, KEYS, "left")
        .withColumn("no_outs", F.col("Outs") == 0)  # before unknown outs are filled
        .na.fill(0, subset=counts)
        .na.fill(False, subset=["pitched", "charged"])
        .join(people, "RetroID")
    )
    return board.selectExpr(*_report_columns()).orderBy(
        "Year", "Team", "name_last", "name_first", "RetroID"
    )

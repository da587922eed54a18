"""Pitching jobs over plays and game logs.

A season's plays may be dominated by one pitcher or team, so every job
reduces plays with mergeable aggregates (sums, and distinct games spread by
game id): Spark combines them before the shuffle and no task ever holds a
whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline import constants as K
from statline.functions.exprs import (
    SEASON_PARTITION,
    any_of,
    fielding_team,
    has_id,
    is_blank,
    is_true,
    one_if,
    season_of,
)

BASES = (1, 2, 3)
RUN_TO = ("2", "3", "H")  # base a runner from first, second, third tries for
PICKOFF_MODES = ("as_caught", "flag")


# --------------------------------------------------------------------------
# value of one play, per statistic
# --------------------------------------------------------------------------


def play_metrics() -> dict[str, Column]:
    """What one play adds to each of its pitcher's batting-against counts."""
    event, hit = F.col("event_cd"), F.col("h_cd")
    return {
        "PA": one_if(is_true("bat_event_fl")),
        "AB": one_if(is_true("ab_fl")),
        "H": one_if(hit > 0),
        "DB": one_if(hit == K.HIT_DOUBLE),
        "TP": one_if(hit == K.HIT_TRIPLE),
        "HR": one_if(hit == K.HIT_HOME_RUN),
        "RBI": F.col("rbi_ct"),
        "Outs": F.col("event_outs_ct"),
        "BB": one_if(event.isin(K.EVENT_WALK, K.EVENT_INTENTIONAL_WALK)),
        "SO": one_if(event == K.EVENT_STRIKEOUT),
        "GDP": one_if(is_true("dp_fl") & (F.col("battedball_cd") == K.GROUND_BALL)),
        "HBP": one_if(event == K.EVENT_HIT_BY_PITCH),
        "SH": one_if(is_true("sh_fl")),
        "SF": one_if(is_true("sf_fl")),
        "IBB": one_if(event == K.EVENT_INTENTIONAL_WALK),
    }


# every metric but outs is also reported against each batter hand
SPLIT_METRICS = (
    "PA", "AB", "H", "DB", "TP", "HR", "RBI", "BB", "SO", "GDP", "HBP", "SH", "SF", "IBB",
)
ALL_METRICS = (*SPLIT_METRICS[:7], "Outs", *SPLIT_METRICS[7:])


def _by_hand(events: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Sums per responsible pitcher and batter hand.

    The hand as a key lets one sum per metric serve totals and both splits;
    :func:`_fold_hands` works on what is left, a few rows per pitcher-season.
    """
    return events.groupBy(
        season_of().alias("Year"),
        fielding_team().alias("Team"),
        F.col("resp_pit_id").alias("RetroID"),
        F.col("resp_bat_hand_cd").alias("hand"),
    ).agg(*[F.sum(value).alias(name) for name, value in metrics.items()])


def _fold_hands(by_hand: DataFrame) -> DataFrame:
    """One row per pitcher-season: totals over all hands, then each split."""
    keys = ("Year", "Team", "RetroID")
    sums = [f"sum({c}) AS {c}" for c in by_hand.columns if c not in (*keys, "hand")]
    sums += [
        f"sum(CASE WHEN hand = '{hand}' THEN {c} ELSE 0 END) AS {c}_{hand}"
        for hand in K.BATTER_HANDS
        for c in SPLIT_METRICS
    ]
    return by_hand.groupBy(*keys).agg(*map(F.expr, sums))


def running_metrics(pickoff_mode: str = "as_caught") -> dict[str, Column]:
    """What one play adds to the sums behind :data:`RUNNING_COLUMNS`.

    ``as_caught`` counts a plain pickoff wherever a runner is caught without
    the pickoff flag, which makes pickoffs equal caught stealings. ``flag``
    counts pickoff flags without a caught stealing instead.
    """
    if pickoff_mode not in PICKOFF_MODES:
        raise ValueError(f"pickoff_mode must be one of {PICKOFF_MODES}, not {pickoff_mode!r}")
    metrics: dict[str, Column] = {}
    for b, to in zip(BASES, RUN_TO):
        cs, pk = F.col(f"run{b}_cs_fl"), F.col(f"run{b}_pk_fl")
        metrics[f"SB{to}"] = one_if(is_true(f"run{b}_sb_fl"))
        metrics[f"CS{to}"] = one_if((cs == "T") & pk.isin("F", "T"))
        metrics[f"POCS{to}"] = one_if((cs == "T") & (pk == "T"))
        bare = cs == "T" if pickoff_mode == "as_caught" else cs == "F"
        wanted = "F" if pickoff_mode == "as_caught" else "T"
        metrics[f"PkO{to}"] = one_if(bare & (pk == wanted))
    metrics["POCS"] = metrics.pop("POCS2") + metrics.pop("POCS3") + metrics.pop("POCSH")
    bare_pickoffs = metrics.pop("PkO2") + metrics.pop("PkO3") + metrics.pop("PkOH")
    return {**metrics, "bare_pickoffs": bare_pickoffs}


RUNNING_COLUMNS = (
    "SB2 + SB3 + SBH AS SB", "CS2 + CS3 + CSH AS CS", "SB2", "SB3", "SBH", "CS2", "CS3", "CSH",
    "bare_pickoffs + POCS AS PkO", "POCS",
)


def steal_chances() -> Column:
    """Chances on one play: a runner with the next base open, from first or second."""
    occupied = {b: ~is_blank(f"base{b}_run_id") for b in BASES}
    empty = {b: is_blank(f"base{b}_run_id") for b in BASES}
    batter = is_true("bat_event_fl")
    return one_if(batter & occupied[1] & empty[2]) + one_if(batter & occupied[2] & empty[3])


def is_earned(destination: Column) -> Column:
    return destination.isin(*K.DESTINATIONS_EARNED)


# --------------------------------------------------------------------------
# jobs
# --------------------------------------------------------------------------


Bound = int | str | None


def _within(column: Column, start: Bound, end: Bound) -> Column:
    """Whether a year lies in ``start``..``end``; None leaves a side open."""
    inside = F.lit(True)
    if start is not None:
        inside &= column >= F.lit(start)
    return inside if end is None else inside & (column <= F.lit(end))


def _text(bound: Bound) -> str | None:
    return None if bound is None else str(bound)


def _files_within(df: DataFrame, start: Bound, end: Bound) -> DataFrame:
    """``df`` without files of other seasons, where its loader knows that files lie by season."""
    if SEASON_PARTITION not in df.columns or (start is None and end is None):
        return df
    bounds = [None if b is None else int(b) for b in (start, end)]
    return df.where(_within(F.col(SEASON_PARTITION), *bounds))


def events_in_years(events: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """Plays of the seasons ``start``..``end``, all by default.

    The season comes out of the game id. Where the loader knows that files lie by
    season, the same bounds prune these first.
    """
    plays = _files_within(events, start, end).drop(SEASON_PARTITION)
    if start is None and end is None:
        return plays
    return plays.where(_within(season_of(), _text(start), _text(end)))


def games_pitched(events: DataFrame) -> DataFrame:
    """Distinct games per pitcher, as pitcher of record on the play or in fact."""
    on_the_play = F.filter(F.array_distinct(F.array("pit_id", "resp_pit_id")), has_id)
    appearances = events.select(
        season_of().alias("Year"),
        fielding_team().alias("Team"),
        "game_id",
        F.explode(on_the_play).alias("RetroID"),
    )
    return (
        appearances.distinct()
        .groupBy("Year", "Team", "RetroID")
        .agg(F.count(F.lit(1)).alias("G"))
    )


def game_log_decisions(gamelogs: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """Starts, wins, losses and saves from game logs; ties give starts only.

    ``start`` and ``end`` bound the season; None leaves a side open.
    """
    year = F.substring("yyyymmdd", 1, 4)
    home_won = F.col("homscore") > F.col("visscore")
    decided = F.col("homscore") != F.col("visscore")
    winner = F.when(home_won, F.col("homteam")).otherwise(F.col("visteam"))
    loser = F.when(home_won, F.col("visteam")).otherwise(F.col("homteam"))
    stats = ("GS", "W", "L", "SV")

    def credit(team: Column, pitcher: str, stat: str) -> Column:
        return F.struct(
            team.alias("Team"),
            F.col(pitcher).alias("RetroID"),
            *[F.lit(int(s == stat)).alias(s) for s in stats],
        )

    credits = F.array(
        credit(F.col("homteam"), "homspid", "GS"),
        credit(F.col("visteam"), "visspid", "GS"),
        F.when(decided, credit(winner, "winpitid", "W")),
        F.when(decided, credit(loser, "lospitid", "L")),
        F.when(decided, credit(winner, "svpitid", "SV")),
    )
    named = F.filter(credits, lambda c: c.isNotNull() & has_id(c["RetroID"]))
    # the bounds once more on the whole date, which files keep ranges of
    dated = _within(F.col("yyyymmdd"), _text(start), None if end is None else f"{end}~")
    return (
        _files_within(gamelogs, start, end)
        .where(_within(year, _text(start), _text(end)) & dated)
        .select(year.alias("Year"), F.inline(named))
        .groupBy("Year", "Team", "RetroID")
        .agg(*[F.sum(s).alias(s) for s in stats])
    )


def pitching_events(events: DataFrame) -> DataFrame:
    """Batting-against totals and splits per responsible pitcher."""
    splits = [f"{m}_{hand}" for hand in K.BATTER_HANDS for m in SPLIT_METRICS]
    return _fold_hands(_by_hand(events, play_metrics())).selectExpr(
        "Year", "RetroID AS Resp_pit_id", "Team", *ALL_METRICS, *splits
    )


def _by_pitcher(events: DataFrame, *sums: Column) -> DataFrame:
    return events.groupBy(
        season_of().alias("Year"), fielding_team().alias("Team"),
        F.col("resp_pit_id").alias("RetroID"),
    ).agg(*sums)


def running_game(events: DataFrame, pickoff_mode: str = "as_caught") -> DataFrame:
    """Steals, caught stealings and pickoffs per pitcher with at least one."""
    metrics = running_metrics(pickoff_mode)
    kinds = ("sb", "cs") if pickoff_mode == "as_caught" else ("sb", "cs", "pk")
    flagged = any_of(is_true(f"run{b}_{kind}_fl") for b in BASES for kind in kinds)
    sums = [F.sum(value).alias(name) for name, value in metrics.items()]
    # a caught stealing without a pickoff flag either way counts as nothing
    return (
        _by_pitcher(events.where(flagged), *sums)
        .selectExpr("Year", "RetroID", "Team", *RUNNING_COLUMNS)
        .where("SB + CS + PkO > 0")
    )


def reached_on_error(events: DataFrame) -> DataFrame:
    """Batters reaching on an error per pitcher."""
    reached = is_true("bat_event_fl") & (F.col("event_cd") == K.EVENT_ERROR)
    return _by_pitcher(events.where(reached), F.count(F.lit(1)).alias("ROE"))


def steal_opportunities(events: DataFrame) -> DataFrame:
    """Steal chances per pitcher with at least one."""
    return _by_pitcher(events.where(steal_chances() > 0), F.sum(steal_chances()).alias("SBO"))


def scoring_credits() -> list[Column]:
    """(pitcher charged, destination) for each runner and the batter."""
    runners = [(f"run{b}_resp_pit_id", f"run{b}_dest_id") for b in BASES]
    return [
        F.struct(F.col(pitcher).alias("RetroID"), F.col(dest).alias("dest"))
        for pitcher, dest in [*runners, ("resp_pit_id", "bat_dest_id")]
    ]


def runs_allowed(events: DataFrame) -> DataFrame:
    """Runs and earned runs, each charged to the pitcher who let the runner on."""
    scored = F.filter(F.array(*scoring_credits()), lambda c: c["dest"] >= K.DESTINATION_SCORED)
    return (
        events.select(
            season_of().alias("Year"), fielding_team().alias("Team"), F.inline(scored)
        )
        .groupBy("Year", "Team", "RetroID")
        .agg(
            F.count(F.lit(1)).alias("R"),
            F.sum(one_if(is_earned(F.col("dest")))).alias("ER"),
        )
    )


def pitcher_lines(events: DataFrame, pickoff_mode: str = "as_caught") -> DataFrame:
    """Batting-against counts, running game and steal chances in one pass."""
    running = running_metrics(pickoff_mode)
    metrics = {**play_metrics(), **running, "SBO": steal_chances()}
    lines = _fold_hands(_by_hand(events, metrics))
    kept = [c for c in lines.columns if c not in running]
    return lines.selectExpr(*kept, *RUNNING_COLUMNS)


def game_lines(events: DataFrame, pickoff_mode: str = "as_caught") -> DataFrame:
    """All counts of :func:`pitcher_lines`, :func:`runs_allowed` and :func:`games_pitched`
    by season, team, game and pitcher, from one reading of the plays.

    A play gives a row to the pitcher responsible, one to the pitcher on the play if that
    is another, and one to each pitcher charged with a run. ``played`` tells whether the
    game counts as pitched, ``pitched`` and ``charged`` whether there was such a row.
    """
    metrics = {**play_metrics(), **running_metrics(pickoff_mode), "SBO": steal_chances()}
    scored = F.col("dest") >= K.DESTINATION_SCORED

    def credit(pitcher: str, dest: Column, played: bool, pitched: bool) -> Column:
        return F.struct(
            F.col(pitcher).alias("RetroID"), dest.alias("dest"),
            F.lit(played).alias("played"), F.lit(pitched).alias("pitched"),
        )

    nothing = F.lit(None).cast("bigint")
    credits = F.array(
        credit("resp_pit_id", F.col("bat_dest_id"), True, True),
        F.when(
            ~F.col("pit_id").eqNullSafe(F.col("resp_pit_id")), credit("pit_id", nothing, True, False)
        ),
        *[credit(f"run{b}_resp_pit_id", F.col(f"run{b}_dest_id"), False, False) for b in BASES],
    )
    named = F.filter(
        credits,
        lambda c: c.isNotNull() & has_id(c["RetroID"])
        & (c["played"] | (c["dest"] >= K.DESTINATION_SCORED)),
    )
    rows = events.select(
        season_of().alias("Year"), fielding_team().alias("Team"), "game_id",
        F.col("resp_bat_hand_cd").alias("hand"),
        *[value.alias(name) for name, value in metrics.items()],
        F.inline(named),
    )
    own = {name: F.when(F.col("pitched"), F.col(name)) for name in metrics}
    by_hand = [
        F.sum(F.when(F.col("hand") == hand, own[name]).otherwise(0)).alias(f"{name}_{hand}")
        for hand in K.BATTER_HANDS
        for name in SPLIT_METRICS
    ]
    return rows.groupBy("Year", "Team", "game_id", "RetroID").agg(
        F.max("played").alias("played"), F.max("pitched").alias("pitched"),
        F.max(F.coalesce(scored, F.lit(False))).alias("charged"),
        F.sum(one_if(scored)).alias("R"),
        F.sum(one_if(scored & is_earned(F.col("dest")))).alias("ER"),
        *[F.sum(value).alias(name) for name, value in own.items()],
        *by_hand,
    )


def season_lines(games: DataFrame) -> DataFrame:
    """Sums of :func:`game_lines` by season, team and pitcher with at least one game."""
    keys = ("Year", "Team", "RetroID")
    flags = ("played", "pitched", "charged")
    running = [c for c in running_metrics() if c != "SBO"]
    sums = [c for c in games.columns if c not in (*keys, *flags, "game_id")]
    lines = games.groupBy(*keys).agg(
        F.count_if("played").alias("G"), F.max("pitched").alias("pitched"),
        F.max("charged").alias("charged"), *[F.sum(c).alias(c) for c in sums],
    )
    kept = [c for c in lines.columns if c not in running]
    return lines.where("G > 0").selectExpr(*kept, *RUNNING_COLUMNS)

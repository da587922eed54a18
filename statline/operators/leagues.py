"""League-season totals, positional fielding at two grains, league factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline import constants as K
from statline.functions.formulas import num, ratio
from statline.operators.team_totals import (
    BATTING_STATS,
    LEAGUE,
    TEAM,
    has_all_positions,
    keyed,
    positional_columns,
)

PITCHING_TOTALS = (
    "W", "L", "BF", "IP", "H", "R", "ER", "HR", "SH", "SF", "HBP", "BB", "SO", "WP", "BK",
    "IP_LHP", "SO_LHP",
)
MISC_TOTALS = ("W_HOME", "L_ROAD")
FIELDING_TOTALS = ("PO", "A", "E", "DP", "PB")


def team_book(
    batting: DataFrame, pitching: DataFrame, misc: DataFrame, fielding: DataFrame
) -> DataFrame:
    """One row per team-season found in all four totals.

    Columns are prefixed ``b_ p_ m_ f_``; sums by position, if ``fielding``
    carries them, keep their names.
    """
    positional = set(positional_columns())

    def tagged(df: DataFrame, prefix: str) -> DataFrame:
        stats = [c for c in df.columns if c not in TEAM]
        return df.selectExpr(
            *TEAM, *[f"`{c}`" if c in positional else f"`{c}` AS `{prefix}_{c}`" for c in stats]
        )

    return (
        tagged(batting, "b")
        .join(tagged(pitching, "p"), list(TEAM))
        .join(tagged(misc, "m"), list(TEAM))
        .join(tagged(fielding, "f"), list(TEAM))
    )


def league_totals(book: DataFrame) -> DataFrame:
    """League sums of :func:`team_book` with runs per out and defensive efficiency."""
    sums = [f"sum(b_{s}) AS `{s}_b`" for s in BATTING_STATS]
    sums += [f"sum(p_{s}) AS {s}_p" for s in PITCHING_TOTALS]
    sums += [f"sum(m_{s}) AS {s}" for s in MISC_TOTALS]
    sums += [f"sum(f_{s}) AS {s}" for s in FIELDING_TOTALS]
    gone = "(p_BB + p_SO + p_HBP)"

    def over(a: str, b: str) -> str:
        return ratio(f"double(sum({a}))", f"double(sum({b}))")

    rates = [
        f"{over('b_R', 'b_AB - b_H + b_CS')} AS RUNS_PER_OUT_LG",
        f"{over(f'p_BF - p_H - {gone}', f'p_BF - p_HR - {gone}')} AS DER_LG",
    ]
    return book.groupBy(*LEAGUE).agg(*map(F.expr, sums + rates))


# --------------------------------------------------------------------------
# fielding by position, per league or per team
# --------------------------------------------------------------------------


def error_rates(tag: str, strikeouts: str) -> list[str]:
    """Errors per chance; a catcher's putouts exclude strikeouts."""
    rates = []
    for pos in K.SHARE_POSITIONS:
        po, a, e = (f"double({s}_{pos.upper()}_{tag})" for s in ("PO", "A", "E"))
        if pos == "c":
            made = f"{po} + {a} - {strikeouts}"
            rate = f"1 - {ratio(made, f'{made} + {e}')}"
        else:
            rate = ratio(e, f"{po} + {a} + {e}")
        rates.append(f"{rate} AS EPct_{pos.upper()}_{tag}")
    return rates


def _positional(
    fielding_totals: DataFrame,
    pitching_totals: DataFrame,
    keys: Sequence[str],
    tag: str,
    strikeouts: str,
) -> DataFrame:
    fielded = keyed(fielding_totals, *keys).where(F.col("Lg") != K.MULTI_LEAGUE)
    counts = [c for c in fielded.columns if c not in TEAM]
    if list(keys) != list(TEAM):
        fielded = fielded.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    fielded = fielded.where(has_all_positions()).selectExpr(
        *keys, *[f"{c} AS {c}_{tag}" for c in positional_columns()]
    )
    struck_out = pitching_totals.groupBy(*keys).agg(F.sum("SO").alias(strikeouts))
    return fielded.join(struck_out, list(keys)).selectExpr("*", *error_rates(tag, strikeouts))


def league_position_fielding(fielding_totals: DataFrame, pitching_totals: DataFrame) -> DataFrame:
    """Fielding per league and position, for leagues fielding all positions.

    Strikeouts include multi-team pitchers' rows where these name a league.
    """
    return _positional(fielding_totals, pitching_totals, LEAGUE, "LG", "SO_p")


def team_position_fielding(fielding_totals: DataFrame, pitching_totals: DataFrame) -> DataFrame:
    """The same per team."""
    return _positional(fielding_totals, pitching_totals, TEAM, "TM", "SO_P_TM")


# --------------------------------------------------------------------------
# league factors
# --------------------------------------------------------------------------

LEAGUE_SINGLES = "(l_H_b - l_2B_b - l_3B_b - l_HR_b)"


def estimate_a(tag: str, runners: str, in_play: str) -> str:
    """Unassisted first-base putouts estimated from the other infielders' assists."""
    return (
        f"PO_1B_{tag} - {num(K.EST_A_PITCHER_ASSISTS)} * A_P_{tag} "
        f"- {num(K.EST_A_SECOND_ASSISTS)} * A_2B_{tag} "
        f"- {num(K.EST_A_LEFT_SIDE_ASSISTS)} * (A_3B_{tag} + A_SS_{tag}) "
        f"+ {num(K.EST_A_RUNNERS)} * {runners} - {num(K.EST_A_BALLS_IN_PLAY)} * ({in_play})"
    )


def estimate_b(tag: str, in_play: str) -> str:
    return f"({in_play}) * {num(K.EST_B_BALLS_IN_PLAY)} - A_1B_{tag}"


def estimate_c(a: str, b: str) -> str:
    return f"(2 * {a} + {b}) / 3"


def first_base_throws(tag: str) -> str:
    """Throws to first base not made by the first baseman himself."""
    return f"A_1B_{tag} + 0.5D * DP_SS_{tag} - PO_P_{tag} + 0.5D * DP_2B_{tag}"


def club_counts(pitching_totals: DataFrame) -> DataFrame:
    """Teams per league-season."""
    return pitching_totals.groupBy(*LEAGUE).agg(
        F.count(F.when(F.col("Tm") != K.MULTI_TEAM, 1)).cast("double").alias("clubs")
    )


def as_doubles(df: DataFrame, prefix: str = "", keys: Sequence[str] = TEAM) -> DataFrame:
    """All but the keys as doubles, ready for formulas, under a prefix."""
    return df.selectExpr(
        *[f"`{c}`" if c in keys else f"double(`{c}`) AS `{prefix}{c}`" for c in df.columns]
    )


def with_league_factors(board: DataFrame) -> DataFrame:
    """Add the estimates team stages compare against.

    Needs league totals under ``l_``, ``*_LG`` sums by position and ``clubs``,
    all doubles.
    """
    in_play = "3 * l_IP_p - l_SO_p"
    return board.withColumns(
        {
            name: F.expr(text)
            for name, text in {
                "X_Lg": ratio(first_base_throws("LG"), "clubs"),
                "ROB_Lg": f"{LEAGUE_SINGLES} + l_BB_p + l_HBP_p - PB_C_LG - l_WP_p - l_BK_p",
                "EstB_Lg": estimate_b("LG", in_play),
                "FA_Lg": "1 - EPct_3B_LG",
                "SHR_Lg": ratio("l_SH_p", "l_W_p + 2 * l_L_p"),
            }.items()
        }
    ).selectExpr("*", f"{estimate_a('LG', 'ROB_Lg', in_play)} AS EstA_Lg").selectExpr(
        "*", f"{estimate_c('EstA_Lg', 'EstB_Lg')} AS EstC_Lg"
    )


LEAGUE_FACTORS = ("X_Lg", "ROB_Lg", "EstA_Lg", "EstB_Lg", "EstC_Lg", "FA_Lg", "SHR_Lg")


def league_factors(positions: DataFrame, totals: DataFrame, clubs: DataFrame) -> DataFrame:
    """Per-league factors on their own."""
    board = (
        as_doubles(positions.drop("SO_p"))
        .join(as_doubles(totals, "l_"), list(LEAGUE))
        .join(clubs, list(LEAGUE))
    )
    return with_league_factors(board).select(*LEAGUE, *LEAGUE_FACTORS)

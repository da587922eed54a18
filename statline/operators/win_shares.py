"""Team stages of the fielding value split.

Each stage adds columns to one wide row per team-season, so later stages join
nothing they already have. Columns, all doubles: ``b_ p_ f_ m_`` for the
team's batting, pitching, fielding and game-log totals, ``l_`` for its
league's, ``*_TM`` and ``*_LG`` for fielding by position, ``prf``/``phf`` for
park factors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline import constants as K
from statline.functions.formulas import guarded_sqrt, nonzero, num, ratio
from statline.operators.leagues import (
    LEAGUE_SINGLES,
    as_doubles,
    error_rates,
    estimate_a,
    estimate_b,
    estimate_c,
    first_base_throws,
    with_league_factors,
)
from statline.operators.team_totals import LEAGUE, TEAM, positional_columns, with_br_code

STAGE1_OUTPUT = (
    "DER", "P-S", "MR", "MRA", "P_Pct", "OW", "DW", "PW", "FW",
    "CL-1", "CL-2", "CL-3", "CL-4", "CL-5", "CL-6", "EDP2", "O-0", "P-0", "TLPOP", "LH",
)
STAGE2_OUTPUT = ("ROB", "EstA", "EstB", "EstC", "X", "EPO_2B", "EPO_SS", "EE", "SHR", "EA")


def with_formulas(board: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Add named formulas over columns the board already has."""
    return board.selectExpr("*", *[f"{text} AS `{name}`" for name, text in formulas.items()])


def with_league_and_park(
    book: DataFrame, totals: DataFrame, factors: DataFrame, teams: DataFrame
) -> DataFrame:
    """The team book with its league's totals and its park's factors."""
    parks = with_br_code(
        factors.selectExpr(
            "YearID AS Year", "Lg", "Tm AS retro",
            "park_run_factor AS prf", "park_hr_factor AS phf",
        ),
        teams,
    ).drop("retro")
    return (
        as_doubles(book)
        .join(parks, list(TEAM))
        .join(as_doubles(totals, "l_", LEAGUE), list(LEAGUE))
    )


# --------------------------------------------------------------------------
# stage 1: offence, pitching, fielding
# --------------------------------------------------------------------------

IN_PLAY = "(3 * p_IP - p_SO)"  # outs on balls in play
LEAGUE_IN_PLAY = "(3 * l_IP_p - l_SO_p)"
_NOT_IN_PLAY = "(p_BB + p_SO + p_HBP)"
_LEAGUE_RUNS = ratio("l_R_p", "l_IP_p")


def _park_adjustment() -> str:
    homers = ratio(f"l_HR_b * {num(K.HOME_RUN_VALUE)}", "l_R_b")
    return guarded_sqrt(ratio(f"prf - phf * {homers}", f"1 - {homers}"))


def _expected_double_plays() -> str:
    singles = ratio(LEAGUE_SINGLES, "l_H_b - l_HR_b")
    runners = f"{singles} * (p_H - p_HR) + p_BB + p_HBP - p_SH - p_WP - p_BK"
    # home runs, not hit batsmen, belong in this denominator
    league_runners = f"{LEAGUE_SINGLES} + l_BB_p + l_HR_p - l_SH_p - l_WP_p - l_BK_p - l_PB"
    assists = ratio(ratio("f_A", "p_IP"), ratio("l_A", "l_IP_p"))
    return f"({runners}) * {ratio('l_DP', league_runners)} * {assists}"


def stage1(board: DataFrame) -> DataFrame:
    """Split team wins into offence, pitching and fielding."""
    low, high = num(K.MARGIN_OFFENCE), num(K.MARGIN_DEFENCE)
    homers = ratio("l_HR_p", nonzero("l_IP_p"))
    own_homers = ratio("p_HR", f"coalesce({nonzero('phf')}, 1D)")
    left_share = ratio("3 * l_IP_LHP_p - l_SO_LHP_p", LEAGUE_IN_PLAY)
    board = with_formulas(
        board,
        {
            "DERq": ratio(f"p_BF - p_H - {_NOT_IN_PLAY}", f"p_BF - p_HR - {_NOT_IN_PLAY}"),
            "P-S": _park_adjustment(),
            "MR": f"b_R - {_LEAGUE_RUNS} * prf * {low} * (p_IP - m_W_HOME + m_L_ROAD)",
            "MRA": f"{_LEAGUE_RUNS} * prf * {high} * p_IP - p_R",
            "CL-2": f"{num(K.CL2_SLOPE)} * ({ratio('p_SO * 9', 'p_IP')} + {num(K.CL2_OFFSET)})",
            "CL-3": f"{ratio('l_HBP_p + l_BB_p', 'l_IP_p')} * p_IP - p_BB - p_HBP + {K.CL3_BASE}",
            "CL-4": f"{K.CL4_SLOPE} * ({homers} * p_IP - {own_homers}) + {K.CL4_BASE}",
            "CL-5": f"{K.CL5_BASE} + {ratio('l_E + 0.5D * l_PB', 'l_IP_p')} * p_IP "
            "- 0.5D * f_PB - f_E",
            "EDP2": _expected_double_plays(),
            "O-0": f"{ratio('l_R_b', 'l_AB_b - l_H_b + l_CS_b')} * {low} * prf",
            "TLPOP": ratio("f_PO - p_SO", "l_PO - l_SO_p"),
            "LH": f"3 * p_IP_LHP - p_SO_LHP - {left_share} * {IN_PLAY}",
            "x_runs": f"{ratio('l_R_p * 9', 'l_IP_p')} * prf * {high}",
        },
    )
    board = with_formulas(
        board,
        {
            "DER": f"1 - {ratio('1 - DERq', '`P-S`')}",
            "CL-6": f"{K.CL6_BASE} + (f_DP - EDP2) * 4 / 3",
            "OW": f"{ratio('MR', 'MR + MRA')} * {K.WIN_SHARES_PER_WIN} * p_W",
        },
    )
    board = with_formulas(
        board,
        {
            "CL-1": f"{K.CL1_BASE} + {K.CL1_SLOPE} * (DER - l_DER_LG)",
            "DW": f"{K.WIN_SHARES_PER_WIN} * p_W - OW",
        },
    )
    won = f"{K.WPCT_WEIGHT} * p_WPCT"
    claims = "`CL-1` + `CL-2` + `CL-3` + `CL-4`"
    raw = ratio(
        f"{claims} + {won} + {K.PITCHING_BASE}",
        f"2 * {claims} + `CL-5` + `CL-6` + {num(K.TOTAL_BASE)} + {won}",
    )
    floor, ceiling = num(K.P_PCT_FLOOR), num(K.P_PCT_CEILING)
    return with_formulas(
        with_formulas(board, {"raw": raw}),
        {
            "P_Pct": f"CASE WHEN raw < {floor} THEN {floor} "
            f"WHEN raw > {ceiling} THEN {ceiling} ELSE raw END",
            "PW": "DW * raw",
            "FW": "DW - DW * raw",
            "P-0": f"x_runs - (x_runs - {ratio('p_ER * 9', 'p_IP')}) * (1 - raw)",
        },
    )


# --------------------------------------------------------------------------
# stage 2: expected plays
# --------------------------------------------------------------------------


def with_positions(board: DataFrame, league_positions: DataFrame, clubs: DataFrame) -> DataFrame:
    """Add rates by position for the team and its league, and league factors.

    The team's sums by position are on the board already.
    """
    positional = positional_columns()
    team = board.where(F.col("Lg") != K.MULTI_LEAGUE).selectExpr(
        *[f"`{c}` AS {c}_TM" if c in positional else f"`{c}`" for c in board.columns]
    )
    league = as_doubles(league_positions.drop("SO_p"), keys=LEAGUE)
    return with_league_factors(
        team.selectExpr("*", *error_rates("TM", "p_SO"))
        .join(league, list(LEAGUE))
        .join(clubs, list(LEAGUE))
    )


def _expected_putouts(pos: str, walks: int, left: int) -> str:
    share = ratio(f"(f_PO - p_SO) * PO_{pos}_LG", "l_PO - l_SO_p")
    extra_walks = f"(p_BB - {ratio('l_BB_p', 'l_IP_p')} * p_IP)"
    return f"{share} + {extra_walks} / {walks} + LH / {left}"


def stage2(board: DataFrame) -> DataFrame:
    """Expected plays a team's fielders faced."""
    singles = ratio(f"(p_H - p_HR) * {LEAGUE_SINGLES}", "l_H_b - l_HR_b")
    board = with_formulas(board, {"ROB": f"{singles} + p_BB + p_HBP - p_WP - f_PB - p_BK"})
    board = with_formulas(
        board,
        {
            "EstA": estimate_a("TM", "ROB", IN_PLAY),
            "EstB": estimate_b("TM", IN_PLAY),
            "X": f"{first_base_throws('TM')} + {num(K.X_LH)} * LH",
            "EPO_2B": _expected_putouts("2B", K.EPO_2B_WALKS, K.EPO_2B_LH),
            "EPO_SS": _expected_putouts("SS", K.EPO_SS_WALKS, K.EPO_SS_LH),
            "EE": f"{ratio('PO_3B_TM + PO_SS_TM', 'FA_Lg')} - PO_3B_TM - PO_SS_TM",
            "SHR": ratio("p_SH", "p_W + 2 * p_L"),
            "EA": f"{ratio('f_A * A_3B_LG', 'l_A')} + LH / {K.EA_LH}",
        },
    )
    return with_formulas(board, {"EstC": estimate_c("EstA", "EstB")})


# --------------------------------------------------------------------------
# stage 3: positional scores
# --------------------------------------------------------------------------


def positional_scores() -> dict[str, list[str]]:
    """The four part scores of each position."""
    c, fb, sb, tb, ss, of = (K.SCORES[p] for p in K.SHARE_POSITIONS)

    def plus(gain: str, part: tuple[float, float]) -> str:
        """Base score plus a gain in plays per scale."""
        return f"({gain}) / {part[1]} + {part[0]}"

    def minus(rate: str, part: tuple[float, float]) -> str:
        return f"{part[0]} - {rate} * {part[1]}"

    def errors(pos: str, part: tuple[float, float]) -> str:
        """Base score less the team's error rate relative to the league's."""
        return f"{part[0]} - {ratio(f'{part[1]} * EPct_{pos}_TM', f'EPct_{pos}_LG')}"

    def caught(tag: str) -> str:
        return ratio(f"CS_C_{tag}", f"{nonzero(f'SB_C_{tag}')} + CS_C_{tag}")

    first = f"EstC + A_1B_TM + {num(K.FIRST_LH)} * LH - (EstC_Lg + A_1B_LG) * TLPOP"
    left_errors = ratio("E_3B_TM + E_SS_TM", "(E_3B_LG + E_SS_LG) * TLPOP")
    second = f"A_2B_TM - DP_2B_TM - ((A_2B_LG - DP_2B_LG) * TLPOP - LH / {K.SECOND_LH})"
    third_dp = ratio("EDP2 * DP_3B_LG", nonzero("l_DP"))
    short = f"A_SS_TM - (f_A * {ratio('A_SS_LG', 'l_A')} + LH / {K.SHORT_LH})"
    flies = ratio("PO_OF_TM", "f_PO - f_A - p_SO")
    league_flies = ratio("PO_OF_LG", "l_PO - l_A - l_SO_p")
    arms = "A_OF_TM + DP_OF_TM - p_SF - (A_OF_LG + DP_OF_LG - l_SF_p) * TLPOP"
    sf_rate = ratio("p_SF", f"({nonzero('l_SF_p')}) * l_HR_p")
    return {
        "c": [
            f"({caught('TM')} - {caught('LG')}) * {c[0][1]} + {c[0][0]}",
            errors("C", c[1]),
            plus("PB_C_TM - PB_C_LG * TLPOP", c[2]),
            minus(sf_rate, c[3]),
        ],
        "1b": [
            plus(first, fb[0]),
            errors("1B", fb[1]),
            plus("X - X_Lg", fb[2]),
            minus(left_errors, fb[3]),
        ],
        "2b": [
            plus("f_DP - EDP2", sb[0]),
            plus(second, sb[1]),
            errors("2B", sb[2]),
            plus("PO_2B_TM - EPO_2B", sb[3]),
        ],
        "3b": [
            plus("A_3B_TM - EA", tb[0]),
            plus("EE - E_3B_TM", tb[1]),
            minus(ratio("SHR", nonzero("SHR_Lg")), tb[2]),
            plus(f"DP_3B_TM - {third_dp}", tb[3]),
        ],
        "ss": [
            plus(short, ss[0]),
            plus("f_DP - EDP2", ss[1]),
            errors("SS", ss[2]),
            plus("PO_SS_TM - EPO_SS", ss[3]),
        ],
        "of": [
            f"({flies} - {league_flies}) * {of[0][1]} + {of[0][0]}",
            f"`CL-1` * {num(of[1][1])} + ({of[1][0]})",
            plus(arms, of[2]),
            errors("OF", of[3]),
        ],
    }


def claim_column(pos: str) -> str:
    return f"c{pos.upper()}_Pct"


def stage3(board: DataFrame) -> DataFrame:
    """Claim percentage of each position: its four scores over a hundred."""
    return with_formulas(
        board,
        {
            claim_column(pos): f"({' + '.join(f'({p})' for p in parts)}) / {K.SCORE_TOTAL}"
            for pos, parts in positional_scores().items()
        },
    )


def share_column(pos: str) -> str:
    return f"{pos}FW"


def positional_team_shares(board: DataFrame) -> DataFrame:
    """A team's fielding wins split over positions by weighted claims."""
    weighted = {
        pos: f"(({claim_column(pos)} - {num(K.SCORE_BASELINE)}) * {K.POSITION_WEIGHTS[pos]})"
        for pos in K.SHARE_POSITIONS
    }
    per_claim = ratio("FW", " + ".join(weighted.values()))
    return with_formulas(board, {"fcr": per_claim}).selectExpr(
        *TEAM, *[f"fcr * {weighted[p]} AS `{share_column(p)}`" for p in K.SHARE_POSITIONS]
    )

"""Fixed values the reports depend on.

Everything here has to keep exactly this value for results to be comparable
with published figures; the formulas that use the values live with the jobs.
"""

from __future__ import annotations

# --- Fixed values: sentinels in season tables -------------------------------
MULTI_TEAM = "TOT"  # one row summing a player's several teams
MULTI_LEAGUE = "MLB"  # league of such a row when the teams span leagues
LEFT_HANDER_MARK = "*"  # trails the name of a left-handed pitcher

# --- Fixed values: play codes -----------------------------------------------
EVENT_STRIKEOUT = 3
EVENT_WALK = 14
EVENT_INTENTIONAL_WALK = 15
EVENT_HIT_BY_PITCH = 16
EVENT_ERROR = 18
HIT_DOUBLE = 2
HIT_TRIPLE = 3
HIT_HOME_RUN = 4
GROUND_BALL = "G"
BATTER_HANDS = ("L", "R")
DESTINATION_SCORED = 4  # this code and every higher one is a run
DESTINATIONS_EARNED = (4, 6)

# --- Fixed values: rating cards ---------------------------------------------
CARD_SLOTS = 8
FIRST_FIVE_POINT_SEASON = 1997  # ratings ran 1-4 before
REPORT_AGES = tuple(range(16, 51))

# --- Fixed values: positions ------------------------------------------------
POSITIONS = ("p", "c", "1b", "2b", "3b", "ss", "of")
SHARE_POSITIONS = ("c", "1b", "2b", "3b", "ss", "of")  # pitchers get none here
FIELDING_STATS = ("INN", "PO", "A", "E", "DP")
CATCHER_STATS = ("PB", "SB", "CS")

# --- Fixed values: innings notation -----------------------------------------
# .1 and .2 mean one and two outs; adding these gives .33 and .67
THIRD_CORRECTION = {"0.1": "0.23", "0.2": "0.47"}

# --- Fixed values: park factors ---------------------------------------------
FIRST_FULL_RECORD_SEASON = 1909  # padded ratios before
PADDED_COUNT = 100
PADDED_GAMES = 10
NEIGHBOUR_OFFSETS = (-2, -1, 1, 2)
PARK_DIMENSIONS = ("lf_dim", "cf_dim", "rf_dim", "lf_w", "cf_w", "rf_w")

# --- Fixed values: league estimates -----------------------------------------
EST_A_PITCHER_ASSISTS = 0.7
EST_A_SECOND_ASSISTS = 0.86
EST_A_LEFT_SIDE_ASSISTS = 0.78
EST_A_RUNNERS = 0.115
EST_A_BALLS_IN_PLAY = 0.0575
EST_B_BALLS_IN_PLAY = 0.1

# --- Fixed values: splitting wins between offence, pitching, fielding -------
WIN_SHARES_PER_WIN = 3
MARGIN_OFFENCE = 0.52
MARGIN_DEFENCE = 1.52
HOME_RUN_VALUE = 1.5
CL1_BASE, CL1_SLOPE = 100, 2500
CL2_SLOPE, CL2_OFFSET = 28.571, 2.5
CL3_BASE = 200
CL4_BASE, CL4_SLOPE = 200, 5
CL5_BASE = 100
CL6_BASE = 100  # slope is 4/3
WPCT_WEIGHT = 405
PITCHING_BASE, TOTAL_BASE = 650, 1097.5
P_PCT_FLOOR, P_PCT_CEILING = 0.16375, 0.32375

# --- Fixed values: left-hander corrections ----------------------------------
X_LH = 0.015
EPO_2B_WALKS, EPO_2B_LH = 13, 32
EPO_SS_WALKS, EPO_SS_LH = 14, 64
EA_LH = 31
FIRST_LH = 0.0285
SECOND_LH = 35
SHORT_LH = 100

# --- Fixed values: positional scores, (base, scale) for the four parts ------
SCORES = {
    "c": ((25, 150), (30, 15), (5, 5), (10, 5)),
    "1b": ((20, 5), (30, 15), (10, 5), (10, 5)),
    "2b": ((20, 3), (15, 6), (24, 14), (5, 12)),
    "3b": ((25, 4), (15, 2), (10, 5), (5, 2)),
    "ss": ((20, 4), (15, 4), (20, 10), (5, 5)),
    "of": ((20, 100), (-9, 0.24), (10, 5), (10, 5)),
}
SCORE_TOTAL = 100
SCORE_BASELINE = 0.2
POSITION_WEIGHTS = {"c": 38, "1b": 12, "2b": 32, "3b": 24, "ss": 36, "of": 58}

# --- Fixed values: player claim points --------------------------------------
MAJOR_LEAGUES = ("AA", "AL", "FL", "NA", "NL", "PL", "UA")
FIRST_MODERN_SEASON = 1901
CLAIM_WEIGHTS = {
    # a catcher's caught stealings count 4, less the 2 that each stolen base tried costs
    "c": {"PO": 1, "A": 2, "E": -8, "DP": 6, "PB": -4, "SB": -2, "CS": 2},
    "1b": {"PO": 1, "A": 2, "E": -5},
    "2b": {"PO": 1, "A": 2, "E": -5, "DP": 1, "RBP": 2},
    "3b": {"PO": 1, "A": 2, "E": -5, "DP": 1, "RBP": 2},
    "ss": {"PO": 1, "A": 2, "E": -5, "DP": 1, "RBP": 2},
    "of": {"PO": 1, "A": 4, "E": -5, "RBP": 2},
}
OUTFIELDERS = 3
SCHEDULE_GAMES = 162
SEASON_INNINGS = 1458

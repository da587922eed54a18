"""Edges the sample tables do not reach."""

from decimal import Decimal

import pytest
from build import by, games, plays, table

from statline import Tables, standard_pitching
from statline.operators import pitching


def report(spark, rows, logs=(), people=("p1", "p2", "p3"), **kw):
    tables = Tables.from_frames(
        {
            "events": plays(spark, *rows),
            "gamelogs": games(spark, *logs),
            "people": table(
                spark,
                "people",
                [{"key_retro": p, "name_last": p.upper(), "name_first": "A"} for p in people]
                + [{"key_retro": "nameless", "name_first": "A"}],
            ),
        }
    )
    return standard_pitching(tables, 1900, 2100, **kw)


def test_season_range_is_closed(spark):
    years = ["1996", "1997", "1998", "1999"]
    df = plays(spark, *[{"game_id": f"AAA{y}04010"} for y in years])
    kept = pitching.events_in_years(df, 1997, "1998").collect()
    assert sorted(r.game_id[3:7] for r in kept) == ["1997", "1998"]


def test_games_count_mound_and_responsible_pitcher_once(spark):
    df = plays(
        spark,
        {},
        {"resp_pit_id": "p2"},
        {"game_id": "AAA199704020"},
        {"pit_id": None, "resp_pit_id": "  "},
        {"pit_id": "", "resp_pit_id": None},
    )
    got = by(pitching.games_pitched(df), "RetroID")
    assert {k: v["G"] for k, v in got.items()} == {"p1": 2, "p2": 1}
    assert {v["Team"] for v in got.values()} == {"BBB"}


def test_home_side_pitches_when_visitors_bat(spark):
    got = by(pitching.games_pitched(plays(spark, {"bat_home_id": 0})), "RetroID")
    assert got["p1"]["Team"] == "AAA" and got["p1"]["Year"] == "1997"


def test_decisions_with_tie_and_missing_people(spark):
    named = {"homspid": "h", "visspid": "v", "winpitid": "w", "lospitid": "l", "svpitid": "s"}
    df = games(
        spark,
        named,
        {**named, "homscore": 1, "visscore": 2},
        {**named, "homscore": 3, "visscore": 3},
        {**named, "winpitid": "  ", "svpitid": None},
        {**named, "homscore": None},
    )
    got = by(pitching.game_log_decisions(df, 1997, 1997), "Team", "RetroID")
    counts = {k: tuple(v[s] for s in ("GS", "W", "L", "SV")) for k, v in got.items()}
    assert counts == {
        ("AAA", "h"): (5, 0, 0, 0),
        ("BBB", "v"): (5, 0, 0, 0),
        ("AAA", "w"): (0, 1, 0, 0),
        ("BBB", "w"): (0, 1, 0, 0),
        ("AAA", "l"): (0, 0, 1, 0),
        ("BBB", "l"): (0, 0, 2, 0),
        ("AAA", "s"): (0, 0, 0, 1),
        ("BBB", "s"): (0, 0, 0, 1),
    }


def test_splits_leave_other_hands_to_the_total(spark):
    df = plays(
        spark,
        {"resp_bat_hand_cd": "L", "h_cd": 2, "rbi_ct": 2},
        {"resp_bat_hand_cd": "R"},
        {"resp_bat_hand_cd": "B"},
        {"resp_bat_hand_cd": None},
    )
    row = by(pitching.pitching_events(df), "Resp_pit_id")["p1"]
    assert (row["PA"], row["PA_L"], row["PA_R"]) == (4, 1, 1)
    assert (row["DB"], row["DB_L"], row["DB_R"], row["RBI"], row["RBI_L"]) == (1, 1, 0, 2, 2)


def test_unknown_pitchers_keep_their_groups(spark):
    df = plays(spark, {"resp_pit_id": None}, {"resp_pit_id": " "}, {})
    assert {r.Resp_pit_id for r in pitching.pitching_events(df).collect()} == {None, " ", "p1"}


RUNNING = [
    {"run1_sb_fl": "T", "run2_sb_fl": "T"},  # double steal
    {"run1_cs_fl": "T"},  # caught
    {"run2_cs_fl": "T", "run2_pk_fl": "T"},  # picked off, caught
    {"run3_pk_fl": "T", "resp_pit_id": "p2"},  # picked off only
    {"run3_cs_fl": "T", "run3_pk_fl": None, "resp_pit_id": "p3"},  # unknown
]


@pytest.mark.parametrize(
    "mode,expected",
    [
        ("as_caught", {"p1": (2, 2, 2, 1)}),
        ("flag", {"p1": (2, 2, 1, 1), "p2": (0, 0, 1, 0)}),
    ],
)
def test_running_game_modes(spark, mode, expected):
    got = by(pitching.running_game(plays(spark, *RUNNING), mode), "RetroID")
    names = ("SB", "CS", "PkO", "POCS")
    assert {k: tuple(v[n] for n in names) for k, v in got.items()} == expected
    p1 = got["p1"]
    assert (p1["SB2"], p1["SB3"], p1["SBH"], p1["CS2"], p1["CS3"], p1["CSH"]) == (1, 1, 0, 1, 1, 0)


def test_unknown_pickoff_mode(spark):
    with pytest.raises(ValueError, match="pickoff_mode"):
        pitching.running_game(plays(spark), "other")


def test_steal_chances_count_twice_and_skip_unknown_bases(spark):
    df = plays(
        spark,
        {"base1_run_id": "a"},
        {"base2_run_id": "a", "base3_run_id": " "},
        {"base1_run_id": "a", "base2_run_id": "b"},
        {"base1_run_id": "a", "base2_run_id": None},
        {"base1_run_id": "a", "bat_event_fl": "F"},
    )
    assert by(pitching.steal_opportunities(df), "RetroID")["p1"]["SBO"] == 3


def test_runs_follow_the_pitcher_charged(spark):
    df = plays(
        spark,
        {"bat_dest_id": 4, "run1_dest_id": 5, "run1_resp_pit_id": "p2"},
        {"run3_dest_id": 6, "run3_resp_pit_id": "p2", "run2_dest_id": 3, "run2_resp_pit_id": "p3"},
        {"bat_dest_id": 7},
    )
    got = by(pitching.runs_allowed(df), "RetroID")
    assert {k: (v["R"], v["ER"]) for k, v in got.items()} == {"p1": (2, 1), "p2": (2, 1)}


def test_earned_run_average_cases(spark):
    out = {"event_outs_ct": 1}
    rows = [
        {"resp_pit_id": "p1", "pit_id": "p1", "bat_dest_id": 4},  # earned run, no out
        {"resp_pit_id": "p2", "pit_id": "p2", "bat_dest_id": 5},  # unearned run, no out
        {"resp_pit_id": "p3", "pit_id": "p3", **out},  # no run at all
        {"resp_pit_id": "p4", "pit_id": "p4", "bat_dest_id": 5, **out},  # unearned only
        {"resp_pit_id": "p5", "pit_id": "p5", "bat_dest_id": 4, **out},
        *[{"resp_pit_id": "p5", "pit_id": "p5", **out}] * 4,
        {"resp_pit_id": "p1", "pit_id": "p6"},  # on the mound, charged with nothing
        {"resp_pit_id": "nameless", "pit_id": "nameless"},
        {"resp_pit_id": "stranger", "pit_id": "stranger"},
    ]
    got = by(report(spark, rows, people=[f"p{i}" for i in range(1, 7)]), "RetroID")
    era = {k: (v["ERA"], v["ERA_is_inf"]) for k, v in got.items()}
    assert era == {
        "p1": (None, True),
        "p2": (None, False),
        "p3": (None, False),
        "p4": (Decimal("0.00"), False),
        "p5": (Decimal("5.40"), False),
        "p6": (None, False),
    }
    assert got["p5"]["IP"] == Decimal("1.2") and got["p3"]["IP"] == Decimal("0.1")
    assert got["p6"]["G"] == 1 and got["p6"]["PA"] == 0 and got["p6"]["AVG"] is None


def test_rates_round_half_up(spark):
    rows = [{"h_cd": 1}] * 5 + [{}] * 11  # 5/16 = .3125
    assert by(report(spark, rows), "RetroID")["p1"]["AVG"] == Decimal("0.313")


def test_report_order_and_width(spark):
    rows = [
        {"resp_pit_id": "p2", "pit_id": "p2"},
        {"game_id": "AAA199604010"},
        {"resp_pit_id": "p1", "pit_id": "p1", "bat_home_id": 0},
    ]
    df = report(spark, rows)
    assert len(df.columns) == 88 and len(set(c.lower() for c in df.columns)) == 88
    order = [(r.Year, r.Team, r.RetroID) for r in df.collect()]
    assert order == [("1996", "BBB", "p1"), ("1997", "AAA", "p1"), ("1997", "BBB", "p2")]


def test_long_innings_do_not_overflow(spark):
    rows = [{"event_outs_ct": 2_000_000_000}] * 2
    assert by(report(spark, rows), "RetroID")["p1"]["IP"] == Decimal("1333333333.1")

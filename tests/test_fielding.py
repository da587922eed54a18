"""Edges of the fielding jobs, and invariants on the sample tables."""

import itertools
import math
import random
from decimal import Decimal

import pytest
from build import by, games, table

from statline import FieldingWinShares
from statline.constants import PARK_DIMENSIONS, POSITIONS
from statline.operators import claims, leagues, parks, team_totals
from statline.sources.durable import StageStore
from statline.sources.sample import SampleTables

SF_DIR = "/root/testdata/sf0.01"
TEAM = ("Year", "Lg", "Tm")


def teams(spark, *codes):
    rows = [
        {"yearid": y, "lgid": lg, "teamidretro": r, "teamidbr": b} for y, lg, r, b in codes
    ]
    return table(spark, "teams", rows)


PITCHER = {
    "year": 1950, "lg": "AL", "tm": "X", "name": "n", "ip": "9.0",
    **{c: 1 for c in ("w", "l", "gs", "bf", "h", "r", "er", "hr", "hbp", "bb", "so", "wp", "bk")},
}
FIELDER = {
    "year": 1950, "lg": "AL", "tm": "X", "name": "n", "name-additional": "id",
    "inn": 9, "po": 3, "a": 2, "e": 1, "dp": 1, "pb": 0, "sb": 0, "cs": 0,
}


def pitchers(spark, *rows):
    return team_totals.pitching_team_seasons(table(spark, "pitching", list(rows), PITCHER))


def fielders(spark, *rows):
    from pyspark.sql import functions as F

    kept = None
    for pos in POSITIONS:
        own = [r for r in rows if r.get("pos", pos) == pos]
        df = table(spark, f"fielding_{pos}", own, FIELDER).withColumn("pos", F.lit(pos))
        kept = df if kept is None else kept.unionByName(df)
    return kept


# --- team totals ---------------------------------------------------------------


def test_innings_notation_adds_up(spark):
    df = pitchers(spark, {"ip": "5.0"}, {"ip": "5.1"}, {"ip": "5.2"}, {"ip": "0.2", "name": "l*"})
    row = by(team_totals.team_innings(df), *TEAM)[(1950, "AL", "X")]
    assert row["IP"] == Decimal("16.67")
    left = by(team_totals.left_hander_split(df), *TEAM)[(1950, "AL", "X")]
    assert left["IP_LHP"] == Decimal("0.67") and left["SO_LHP"] == 1


def test_missing_hit_batsmen_count_as_none(spark):
    assert pitchers(spark, {"hbp": None}, {"hbp": 2}).first().HBP == 2


def test_sacrifices_come_from_the_other_side(spark):
    logs = games(
        spark,
        {"homsh": 4, "vissh": 2, "homsf": -1, "vissf": None},
        {"homteam": "BBB", "visteam": "AAA", "homsh": 8, "vissh": 16, "homsf": 1},
    )
    codes = teams(spark, (1997, "AL", "AAA", "A"), (1997, "AL", "BBB", "B"))
    got = by(team_totals.opponent_sacrifices(team_totals.side_totals(logs), codes), "Tm")
    assert (got["A"]["SH"], got["A"]["SF"]) == (10, 1)
    assert (got["B"]["SH"], got["B"]["SF"]) == (20, 0)


def test_double_plays_need_both_sides(spark):
    logs = games(
        spark,
        {"homdp": 1, "visdp": 2},
        {"homteam": "BBB", "visteam": "CCC", "homdp": -1, "visdp": 4},
    )
    codes = teams(spark, *[(1997, "AL", 3 * c, c) for c in "ABC"])
    got = by(team_totals.team_double_plays(team_totals.side_totals(logs), codes), "Tm")
    assert {k: v["DP"] for k, v in got.items()} == {"B": 2}


def test_road_losses_across_leagues_drop_out(spark):
    logs = games(
        spark,
        {"homteam": "AAA", "visteam": "BBB"},
        {"homteam": "BBB", "visteam": "AAA", "homscore": 0, "visscore": 0},
        {"homteam": "NNN", "homleague": "NL", "visteam": "BBB"},
    )
    codes = teams(
        spark, (1997, "AL", "AAA", "A"), (1997, "AL", "BBB", "B"), (1997, "NL", "NNN", "N")
    )
    got = by(team_totals.home_wins_road_losses(team_totals.side_totals(logs), codes), *TEAM)
    counts = {k: (v["W_HOME"], v["L_ROAD"]) for k, v in got.items()}
    assert counts == {(1997, "AL", "A"): (1, 0), (1997, "AL", "B"): (0, 1)}


def test_team_missing_a_position_vanishes(spark):
    rows = [{"pos": p} for p in POSITIONS] + [{"pos": p, "tm": "Y"} for p in POSITIONS[1:]]
    rows += [{"pos": "ss", "tm": "TOT"}]
    totals = team_totals.fielding_team_seasons(fielders(spark, *rows))
    assert {r.Tm for r in leagues.team_position_fielding(totals, pitchers(spark, {})).collect()} == {
        "X"
    }
    # its players still count for the league
    league = leagues.league_position_fielding(totals, pitchers(spark, {})).first()
    assert (league.PO_P_LG, league.PO_SS_LG) == (3, 6)


def test_league_strikeouts_include_multi_team_rows(spark):
    totals = team_totals.fielding_team_seasons(fielders(spark, *[{"pos": p} for p in POSITIONS]))
    pitched = pitchers(spark, {"so": 5}, {"so": 7, "tm": "TOT"})
    assert leagues.league_position_fielding(totals, pitched).first().SO_p == 12
    assert leagues.team_position_fielding(totals, pitched).first().SO_P_TM == 5
    assert leagues.club_counts(pitched).first().clubs == 1


# --- parks ----------------------------------------------------------------------


def park(year, tm="AAA", parkid="PK1", **dims):
    return {"year": year, "retrotm": tm, "parkid": parkid, "lg": "AL",
            **dict.fromkeys(PARK_DIMENSIONS, 300), **dims}


def season(year, home_runs, road_runs, hr=1):
    """One home and one road game of AAA."""
    home = {"yyyymmdd": f"{year}0401", "homscore": home_runs, "visscore": 0, "homhr": hr}
    road = {"yyyymmdd": f"{year}0402", "homteam": "BBB", "visteam": "AAA", "homscore": road_runs}
    return [home, {**road, "visscore": 0, "homhr": hr}]


def factors(spark, logs, parkrows):
    sides = team_totals.side_totals(games(spark, *logs))
    return by(parks.park_factors(sides, table(spark, "parkconfig", parkrows)), "YearID", "Tm")


def test_early_seasons_are_padded(spark):
    got = factors(spark, season(1908, 10, 5), [park(1908)])[(1908, "AAA")]
    assert got["park_run_factor"] == (110 / 11) / (105 / 11)
    assert got["park_hr_factor"] == 1.0 and got["games_home"] == 1


def test_no_comparable_season_uses_its_own(spark):
    logs = season(1950, 10, 5) + season(1951, 7, 7)
    got = factors(spark, logs, [park(1950), park(1951, cf_w=9)])
    assert got[(1950, "AAA")]["park_run_factor"] == 2.0


def test_comparable_seasons_weigh_and_add_neighbours(spark):
    logs = season(1950, 10, 5) + season(1951, 7, 3) + season(1953, 100, 1)
    got = factors(spark, logs, [park(1950), park(1951), park(1952)])[(1950, "AAA")]
    n = 2  # two parks measure the same within two years; 1953 is no neighbour of 1950
    assert got["park_run_factor"] == ((n * 10 + 7) / (n + 1)) / ((n * 5 + 3) / (n + 1))


def test_neighbour_without_a_league_counts(spark):
    other = [{**g, "homleague": None, "visleague": None} for g in season(1951, 7, 3)]
    got = factors(spark, season(1950, 10, 5) + other, [park(1950), park(1951), park(1952)])
    # home games count; a road record is matched by league, so a missing one matches none
    assert got[(1950, "AAA")]["park_run_factor"] == ((2 * 10 + 7) / 3) / (2 * 5 / 2)


def test_comparable_but_alone_is_unknown(spark):
    got = factors(spark, season(1950, 10, 5), [park(1950), park(1951)])[(1950, "AAA")]
    assert got["park_run_factor"] is None


def test_no_road_home_runs_is_unknown_not_an_error(spark):
    logs = season(1950, 10, 5, hr=0)
    assert factors(spark, logs, [park(1950)])[(1950, "AAA")]["park_hr_factor"] is None


def test_comparable_years_against_brute_force(spark):
    rng = random.Random(7)
    rows = [
        park(rng.randint(1950, 1956), rng.choice(["AAA", "BBB"]), rng.choice(["P", "Q"]),
             lf_w=rng.choice([8, 9, None]))
        for _ in range(60)
    ]
    key = ["parkid", *PARK_DIMENSIONS]

    def same(a, b):
        return None not in (*a.values(), *b.values()) and all(a[k] == b[k] for k in key)

    expected = []
    for b in rows:
        years = [
            e["year"] for e in rows if same(b, e) and 0 < abs(b["year"] - e["year"]) <= 2
        ] or [None]
        expected += [(b["year"], b["parkid"], b["retrotm"], b["lg"], y) for y in years]
    df = table(spark, "parkconfig", rows)
    got = [tuple(r) for r in parks.comparable_park_years(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    counted = {(r.YearID, r.Tm): r.n for r in parks.comparable_counts(df).collect()}
    want = {}
    for _, _, tm, _, ext in expected:
        if ext is not None:
            want[ext, tm] = want.get((ext, tm), 0) + 1
    assert counted == want


def test_neighbours_ignore_league_and_skip_the_own_season(spark):
    stats = [(y, lg, "T", 1, y, 0, 0, 0, 0) for y, lg in
             [(1950, "AL"), (1950, "NL"), (1951, "AL"), (1953, "NL"), (1960, "AL")]]
    df = spark.createDataFrame(stats, ["YearID", "Lg", "Tm", *parks.HOME_ROAD])
    got = by(parks.seasons_with_neighbours(df), "YearID", "Lg")
    near = {k: v["near_runs_home"] for k, v in got.items()}
    assert near == {
        (1950, "AL"): 1951, (1950, "NL"): 1951, (1951, "AL"): 1950 + 1950 + 1953,
        (1953, "NL"): 1951, (1960, "AL"): None,
    }


# --- claim points ---------------------------------------------------------------


def claimed(spark, *rows):
    fielding = fielders(spark, *[{"pos": p} for p in POSITIONS], *rows)
    pitching = pitchers(spark, {"ip": "9.0"}).drop("GS")
    return by(
        claims.claim_points(fielding, team_totals.fielding_team_seasons(fielding), pitching),
        "Pos", "BBRefID", "Tm", "Lg", "Year",
    )


def points(got, pos, player="id", tm="X", lg="AL", year=1950):
    return got[pos, player, tm, lg, year]["ClaimPoints"]


def test_claim_formulas_and_floors(spark):
    got = claimed(spark, {"pos": "1b", "name-additional": "idle", "inn": 0},
                  {"pos": "1b", "name-additional": "bad", "e": 9})
    assert points(got, "1b") == 3 + 4 - 5
    assert points(got, "c") == 3 + 2 * 2 - 8 + 6
    assert points(got, "2b") == 3 + 4 - 5 + 1  # own rate equals the team's: no bonus
    assert points(got, "1b", "idle") == 0 and points(got, "1b", "bad") == 0
    assert got["1b", "id", "X", "AL", 1950]["PB"] is None
    assert got["c", "id", "X", "AL", 1950]["PB"] == 0


def test_outfield_rate_is_per_three_men(spark):
    got = claimed(spark)
    bonus = (5 / 9 - 5 / 27) * 9
    assert math.isclose(points(got, "of"), 3 + 8 - 5 + 2 * bonus, abs_tol=1e-6)


def test_who_may_claim(spark):
    got = claimed(
        spark,
        *[{"pos": p, "name-additional": "old", "year": 1900} for p in POSITIONS],
        *[{"pos": p, "name-additional": "minor", "lg": "XX"} for p in POSITIONS],
        *[{"pos": p, "name-additional": "lost", "tm": "Z"} for p in POSITIONS],
    )
    assert {k[0] for k in got if k[1] == "lost"} == {"1b"}  # no team record needed there
    assert not [k for k in got if k[1] in ("old", "minor") or k[0] == "p"]


# --- invariants on the sample tables --------------------------------------------


@pytest.fixture(scope="module")
def shares(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    return FieldingWinShares(SampleTables(spark, SF_DIR), keep=StageStore(folder).keep)


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)


def test_wins_are_split_without_loss(shares):
    starts = by(shares.team_pitching, *TEAM)
    first = by(shares.stage1, "YearID", "Lg", "Tm")
    positional = by(shares.positional_team_shares, *TEAM)
    assert len(first) == len(positional) == 175
    for key, row in first.items():
        assert close(row["OW"] + row["DW"], 3 * starts[key]["W"])
        assert close(row["PW"] + row["FW"], row["DW"])
        assert 0.16375 <= row["P_Pct"] <= 0.32375
        parts = [v for k, v in positional[key].items() if k not in TEAM]
        assert close(sum(parts), row["FW"])


def test_players_share_all_of_a_position(shares):
    positional = by(shares.positional_team_shares, *TEAM)
    report = [r.asDict() for r in shares.report().collect()]
    order = [(r["Pos"], r["Year"], r["Lg"], r["Tm"]) for r in report]
    assert order == sorted(order)
    for key, rows in itertools.groupby(report, lambda r: (r["Year"], r["Lg"], r["Tm"], r["Pos"])):
        assert close(sum(r["FWS"] for r in rows), positional[key[:3]][f"{key[3]}FW"])


def test_lazy_and_stored_stages_agree(spark, shares):
    lazy = FieldingWinShares(SampleTables(spark, SF_DIR), keep=lambda df: df)
    assert by(lazy.stage3, *TEAM) == by(shares.stage3, *TEAM)


def test_one_season_from_that_seasons_rows(spark, shares):
    """Every season's own report is the part of the whole, park factors and all."""
    every = [tuple(r) for r in shares.report().collect()]
    seasons = sorted({r[0] for r in every})
    assert len(seasons) > 3
    for year in (seasons[0], seasons[2], seasons[-1]):
        part = shares.of_season(year)
        mine = [tuple(r) for r in shares.report(year).collect()]
        assert sorted(map(repr, mine)) == sorted(repr(r) for r in every if r[0] == year)
        whole = by(shares.park_factors.where(f"YearID = {year}"), "YearID", "Lg", "Tm")
        assert by(part.park_factors, "YearID", "Lg", "Tm") == whole and whole
    assert shares.report(1800).count() == 0


def test_report_for_one_player(shares):
    every = [r for r in shares.report().collect() if r.Year == 1997 and r.BBRefID == "b07x3"]
    assert every and sorted(shares.report(1997, "b07x3").collect()) == sorted(every)

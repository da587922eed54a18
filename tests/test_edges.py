"""Edges in which rows used to get lost or mixed up."""

import pytest
from build import CARD, GAME, PLAY, games, plays, table
from pyspark.sql import functions as F

from statline import Tables, range_by_age, standard_pitching
from statline.operators import pitching
from statline.operators.ratings import position_slots
from statline.sources.sample import SampleTables
from statline.sources.tables import write_tables
from statline.sources.schemas import DDL

PERSON = {"key_retro": "p1", "name_last": "Last", "name_first": "First"}


def tables(spark, **rows):
    defaults = {"events": PLAY, "gamelogs": GAME, "people": PERSON, "allbatters": CARD}
    return Tables.from_frames(
        {n: table(spark, n, rows.get(n, []), defaults.get(n)) for n in DDL}
    )


def test_every_season_by_default(spark):
    old = plays(spark, {"game_id": "AAA187105040"}, {})
    assert pitching.events_in_years(old).count() == 2
    assert pitching.events_in_years(old, 1900).count() == 1
    assert pitching.events_in_years(old, end=1871).count() == 1
    logs = games(spark, {"yyyymmdd": "18710504", "homspid": "a"}, {"homspid": "b"})
    years = {r.Year for r in pitching.game_log_decisions(logs).collect()}
    assert years == {"1871", "1997"}
    frames = tables(spark, events=[{"game_id": "AAA187105040"}], people=[{}])
    assert [r.Year for r in standard_pitching(frames).collect()] == ["1871"]


def test_a_foreign_season_column_changes_nothing(spark):
    df = plays(spark, {}).withColumn("season", F.lit("spring"))
    assert pitching.events_in_years(df, 1997, 1997).count() == 1
    assert pitching.events_in_years(df, 1998, 1999).count() == 0


def test_long_player_keys_stay_apart(spark, tmp_path):
    day = "timestamp '1998-05-01'"
    keys = (123456, 1234567)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(2)
    rows = orders.limit(1).withColumn("o_custkey", F.explode(F.array(*map(F.lit, keys))))
    kind = orders.schema["o_custkey"].dataType, orders.schema["o_orderdate"].dataType
    rows = rows.withColumn("o_custkey", F.col("o_custkey").cast(kind[0]))
    rows = rows.withColumn("o_orderdate", F.expr(day).cast(kind[1])).select(*orders.columns)
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    cards = SampleTables(spark, str(tmp_path)).cards
    assert cards.select("retroid").distinct().count() == 2


def test_trailing_blanks_do_not_count(spark):
    padded = tables(
        spark,
        events=[{"resp_pit_id": "p1 ", "pit_id": "p1 "}, {"resp_pit_id": " "}, {"resp_pit_id": ""}],
        people=[{"key_retro": "p1"}],
        allbatters=[{"pos1": "C ", "rg1": "3"}],
    )
    assert [r.RetroID for r in standard_pitching(padded).collect()] == ["p1"]
    assert {r.Resp_pit_id for r in pitching.pitching_events(padded.events).collect()} == {"p1", ""}
    assert [r.rg for r in position_slots(padded.cards, "C").collect()] == [3.0]


def test_blank_rating_is_unknown(spark):
    df = table(spark, "allbatters", [{"pos1": "C", "rg1": ""}, {"pos1": "C", "rg1": "2"}], CARD)
    assert sorted(str(r.rg) for r in position_slots(df, "C").collect()) == ["2.0", "None"]
    assert range_by_age(df, "C").first()["25"] == 2.0


@pytest.mark.parametrize("outs,infinite", [(None, False), (0, True), (3, False)])
def test_infinite_average_needs_known_outs(spark, outs, infinite):
    run = {"event_outs_ct": outs, "bat_dest_id": 4}
    report = standard_pitching(tables(spark, events=[run], people=[{}])).collect()
    assert [r.ERA_is_inf for r in report] == [infinite]


def test_season_bounds_prune_files(spark, tmp_path):
    frames = tables(spark, events=[{}, {"game_id": "AAA199804010"}], gamelogs=[{}])
    write_tables(frames, str(tmp_path))
    stored = Tables.from_directory(spark, str(tmp_path), declared=True)
    year = pitching.events_in_years(stored.events, 1998, 1998)
    text = year._jdf.queryExecution().executedPlan().toString()
    assert "season" in text.split("PartitionFilters: ")[1].splitlines()[0]
    assert "cast(season" not in text and year.count() == 1
    assert year.columns == frames.events.columns
    logs = pitching.game_log_decisions(stored.gamelogs, 1997, 1998)
    text = logs._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(yyyymmdd,1997)" in text and "LessThanOrEqual(yyyymmdd,1998~)" in text

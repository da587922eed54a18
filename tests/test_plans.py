"""Shapes of physical plans that have to hold at any size."""

import pytest
from build import plays, table
from pyspark.sql import functions as F

from statline import FieldingWinShares, Tables, range_by_age, standard_pitching
from statline import constants as K
from statline.functions.joins import salted_join
from statline.operators import claims, parks, pitching, team_totals
from statline.sources.sample import SampleTables
from statline.sources.schemas import DDL
from statline.sources.tables import write_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Empty stored tables: plans alone are looked at."""
    path = tmp_path_factory.mktemp("empty")
    for name in DDL:
        table(spark, name, []).write.parquet(str(path / name))
    return Tables.from_directory(spark, str(path), declared=True)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored"))
    write_tables(SampleTables(spark, SF_DIR), path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.write.format("noop").mode("overwrite").save()
    return plan(df)


def scans(text, table_name):
    return sum("FileScan" in line and f"/{table_name}]" in line for line in text.splitlines())


@pytest.mark.parametrize("job", [pitching.running_game, pitching.runs_allowed,
                                 pitching.pitching_events, pitching.games_pitched])
def test_one_scan_of_plays(tables, job):
    text = plan(job(tables.events))
    assert scans(text, "events") == 1 and "Union" not in text


def test_scan_reads_only_what_the_job_needs(tables):
    text = plan(pitching.games_pitched(tables.events))
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "run1" not in schema and "event_cd" not in schema


def test_flag_filter_reaches_the_scan(tables):
    text = plan(pitching.reached_on_error(tables.events))
    assert "EqualTo(event_cd,18)" in text


def test_card_filter_reaches_the_scan(tables):
    text = plan(range_by_age(tables.cards, "C"))
    pushed = text.split("PushedFilters: ")[1].splitlines()[0]
    assert "GreaterThanOrEqual(year,1997)" in pushed and "Or(" in pushed
    assert scans(text, "allbatters") == 1


def test_report_reads_plays_three_times_and_games_once(tables):
    text = plan(standard_pitching(tables, 1900, 2100))
    assert scans(text, "events") == 3 and scans(text, "gamelogs") == 1


def test_game_log_jobs_scan_once(tables):
    assert scans(plan(pitching.game_log_decisions(tables.gamelogs, 1900, 2100)), "gamelogs") == 1
    sides = team_totals.side_totals(tables.gamelogs)
    job = team_totals.home_wins_road_losses(sides, tables.teams)
    assert scans(plan(job), "gamelogs") == 1


def test_no_nested_loops_windows_or_python(tables, spark):
    shares = FieldingWinShares(tables, keep=lambda df: df)
    sides = team_totals.side_totals(tables.gamelogs)
    frames = [
        standard_pitching(tables, 1900, 2100),
        parks.park_factors(sides, tables.parkconfig),
        parks.comparable_park_years(tables.parkconfig),
        shares.report(),
    ]
    for df in frames:
        text = plan(df)
        for bad in ("NestedLoop", "CartesianProduct", "Window", "Python", "BatchEval"):
            assert bad not in text


def test_plays_are_read_once_where_that_is_asked_for(tables):
    text = plan(standard_pitching(tables, 1900, 2100, one_scan=True))
    assert scans(text, "events") == 1 and scans(text, "gamelogs") == 1


def test_scan_of_fielders_sums_each_statistic_once(tables):
    text = plan(team_totals.fielding_team_seasons(tables.fielding))
    phases = [line for line in text.splitlines() if "partial_sum" in line]
    assert len(phases) == 2  # the last of these is the nearest to the scan
    assert phases[-1].count("partial_sum") == 8 and phases[-1].count("partial_count") == 1


SEASON_TABLES = ("teams", "batting", "pitching", *(f"fielding_{p}" for p in K.POSITIONS))


def test_one_season_opens_that_seasons_files(spark, stored):
    tables = Tables.from_directory(spark, stored, declared=True)
    text = plan(FieldingWinShares(tables, keep=lambda df: df).report(1997))
    scanned = [line for line in text.splitlines() if "FileScan" in line]
    for name, first, last in (
        *[(t, 1997, 1997) for t in SEASON_TABLES],
        ("gamelogs", 1995, 1999),
        ("parkconfig", 1995, 1999),
    ):
        mine = [line for line in scanned if f"/{name}]" in line]
        assert mine, name
        for line in mine:
            partitions = line.split("PartitionFilters: [")[1].split("]")[0]
            for bound in (f">= {first})", f"<= {last})"):
                assert bound in partitions, (name, partitions)
    assert len(scanned) == sum(f"/{n}]" in line for line in scanned
                               for n in (*SEASON_TABLES, "gamelogs", "parkconfig"))


def test_decisions_of_some_seasons_open_their_files(spark, stored):
    tables = Tables.from_directory(spark, stored, declared=True)
    text = plan(pitching.game_log_decisions(tables.gamelogs, 1996, 1997))
    assert ">= 1996)" in text.split("PartitionFilters: [")[1].split("]")[0]


# --- work by task, on rows ------------------------------------------------------


def rows_by_task(spark, df):
    """Rows that come out of each task of the last shuffle; broadcasts and mending switched off."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        counts = {r[0]: r[1] for r in df().groupBy(F.spark_partition_id()).count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return sorted(counts.get(i, 0) for i in range(8))


def fielders(spark, n):
    """Rows of shortstops, nine in ten of one team."""
    return (
        spark.range(n)
        .select(
            F.lit(1997).alias("Year"), F.lit("AL").alias("Lg"),
            F.when(F.col("id") % 10 > 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 70)).alias("Tm"),
            F.lit("ss").alias("Pos"), F.col("id").alias("PO"),
        )
    )


def test_a_team_with_most_rows_is_many_tasks_work(spark):
    rows = fielders(spark, 20_000)
    side = rows.select("Year", "Lg", "Tm").distinct().withColumn("IP", F.lit(9))
    keys = ["Year", "Lg", "Tm"]
    plain = rows_by_task(spark, lambda: rows.join(side, keys, "left"))
    assert plain[-1] >= 18_000
    spread = rows_by_task(spark, lambda: salted_join(rows, side, keys, "left"))
    assert sum(spread) == 20_000 and spread[-1] <= 3 * spread[4], spread
    joined = salted_join(rows, side.where("Tm <> 'T10'"), keys, "left")
    assert joined.columns == [*rows.columns, "IP"]
    assert joined.where("IP IS NULL").select("Tm").distinct().collect() == [("T10",)]
    assert salted_join(rows, side.where("Tm = 'T10'"), keys).count() == rows.where("Tm = 'T10'").count()


def test_claims_of_a_team_with_most_rows(spark):
    """The whole job on such rows: its last join's tasks are even."""
    n = 8_000
    names = {"PO": "po", "Pos": "pos", "Year": "year", "Lg": "lg", "Tm": "tm"}
    rows = fielders(spark, n).withColumnsRenamed(names).withColumns(
        {"name": F.lit("n"), "name-additional": F.col("po").cast("string"),
         **{c: F.lit(1).cast("bigint") for c in ("inn", "a", "e", "dp", "pb", "sb", "cs")}}
    )
    everywhere = F.explode(F.array(*map(F.lit, K.POSITIONS))).alias("pos")
    others = rows.select("year", "lg", "tm").distinct().select("*", everywhere).join(
        rows.limit(1).drop("year", "lg", "tm", "pos")
    )
    rows = rows.unionByName(others)
    totals = team_totals.fielding_team_seasons(rows)
    pitched = totals.select("Year", "Lg", "Tm", F.lit(900).alias("IP"))
    spread = rows_by_task(spark, lambda: claims.claim_points(rows, totals, pitched))
    assert sum(spread) >= n and spread[-1] <= 3 * spread[4], spread


def test_a_hot_pitcher_is_summed_before_the_shuffle(spark):
    """Nine plays in ten are one pitcher's: sums of each task's plays come before any exchange."""
    rows = plays(spark, *[{}] * 450, *[{"resp_pit_id": f"x{i}"} for i in range(50)]).repartition(8)
    df = pitching.pitching_events(rows)
    assert {r["Resp_pit_id"]: r["PA"] for r in df.collect()}["p1"] == 450
    steps = plan(df).split("== Initial Plan ==")[0].splitlines()
    exchanges = [i for i, s in enumerate(steps) if "Exchange hashpartitioning" in s]
    sums = [i for i, s in enumerate(steps) if "partial_sum" in s]
    # the plan is printed from its end: the last sum stands below the last exchange by a key
    assert exchanges and sums and max(sums) > max(exchanges)

import csv
from decimal import Decimal

import pytest
from build import CARD, by, plays, table
from pyspark.sql import functions as F

from statline import FieldingWinShares, Tables, range_by_age, standard_pitching
from statline.constants import POSITIONS
from statline.operators.pitching import events_in_years
from statline.operators.ratings import position_slots
from statline.sources import durable as d
from statline.sources.sample import SampleTables
from statline.sources.schemas import DDL, schema
from statline.sources.tables import conform, read_report, write_report, write_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    write_tables(SampleTables(spark, SF_DIR), path)
    return path


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_stored_tables_read_back(spark, stored):
    ours, back = SampleTables(spark, SF_DIR), Tables.from_directory(spark, stored, declared=True)
    assert rows(back.events.drop("season partition")) == rows(ours.events)
    columns = [*schema("fielding_c").names, "pos"]
    assert rows(back.fielding.select(*columns)) == rows(ours.fielding.select(*columns))
    assert rows(standard_pitching(back, 1995, 1997)) == rows(standard_pitching(ours, 1995, 1997))


def test_season_filter_prunes_partitions(spark, stored):
    events = Tables.from_directory(spark, stored, declared=True).events
    assert events_in_years(events, 1996, 1996).count() > 0
    plan = events_in_years(events, 1996, 1996)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_csv_tables(spark, tmp_path):
    cards = SampleTables(spark, SF_DIR).cards
    cards.write.option("header", True).csv(str(tmp_path / "allbatters"))
    back = Tables.from_directory(spark, str(tmp_path), "csv").cards
    assert rows(range_by_age(back, "C")) == rows(range_by_age(cards, "C"))


def test_catalog_tables(spark):
    plays(spark, {}).createOrReplaceTempView("plays_view")
    assert Tables.from_catalog(spark, {"events": "plays_view"}).events.count() == 1


def test_conform_casts_and_fills(spark):
    df = spark.createDataFrame(
        [("1950", "AL", "X", "n", "id", 9, 3, 2, 1, 1)],
        ["year", "LG", "tm", "name", "name-additional", "inn", "po", "a", "e", "dp"],
    )
    out = conform(df, "fielding_ss")
    assert out.schema["year"].dataType.typeName() == "integer"
    assert out.first().pb is None and out.columns == schema("fielding_ss").names
    with pytest.raises(ValueError, match="lacks column"):
        conform(df.drop("po"), "fielding_ss")


def test_report_as_csv_and_parquet(spark, tmp_path):
    report = range_by_age(SampleTables(spark, SF_DIR).cards, "C")
    for kind in ("csv", "parquet"):
        write_report(report, str(tmp_path / kind), kind)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == report.columns and back.count() == report.count()
    assert rows(spark.read.parquet(str(tmp_path / "parquet"))) == rows(report)


def test_standard_pitching_can_be_stored(spark, tmp_path):
    report = standard_pitching(SampleTables(spark, SF_DIR), 1900, 2100)
    write_report(report, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).columns == report.columns


def test_csv_report_comes_back_whole(spark, tmp_path):
    """All columns of the widest report, typed, in the order of the files."""
    report = standard_pitching(SampleTables(spark, SF_DIR))
    assert len(report.columns) == 88
    write_report(report, str(tmp_path / "p9"))
    back = read_report(spark, str(tmp_path / "p9"), report.schema)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in report.schema]
    assert rows(back) == rows(report)
    lines = [line for file in sorted((tmp_path / "p9").glob("part-*"))
             for line in csv.DictReader(file.open(newline=""))]
    keys = ("Year", "Team", "name_last", "name_first", "RetroID")
    in_order = [tuple(r[k] for k in keys) for r in report.collect()]
    assert [tuple(line[k] for k in keys) for line in lines] == in_order and len(in_order) > 100


def test_csv_report_with_odd_texts(spark, tmp_path):
    texts = ["", None, 'say "hi"', '"', "a,b", "two\nlines", "  blanks  ", "back\\slash", '\\"', "é 日本"]
    kind = "n int, text string, x double, d decimal(18,1), flag boolean, big bigint"
    values = [(i, t, None if i % 3 else i / 7, None if i % 4 else Decimal(i), None if i % 2 else True, 1 << 60)
              for i, t in enumerate(texts)]
    frame = spark.createDataFrame(values, kind)
    write_report(frame.orderBy("n"), str(tmp_path / "odd"))
    back = read_report(spark, str(tmp_path / "odd"), frame.schema)
    assert sorted(map(tuple, back.collect())) == values


@pytest.mark.parametrize("kind", ["orc", "json"])
def test_other_formats_hold_the_same_rows(spark, tmp_path, kind):
    sample = SampleTables(spark, SF_DIR)
    for name, attribute in (("gamelogs", "gamelogs"), ("pitching", "pitching"), ("allbatters", "cards")):
        getattr(sample, attribute).write.format(kind).save(str(tmp_path / name))
        back = getattr(Tables.from_directory(spark, str(tmp_path), kind), attribute)
        names = schema(name).names
        assert rows(back.select(names)) == rows(getattr(sample, attribute).select(names))


def test_ranges_of_stored_texts_reach_undeclared_files(spark, tmp_path):
    cards = [
        {"pos1": "C", "rg1": "2"}, {"pos1": "C   ", "rg1": "3"}, {"pos2": "C ", "rg2": "4"},
        {"pos1": "CF", "rg1": "1"}, {"pos1": "", "rg1": "1"}, {"pos1": None}, {"pos3": "c", "rg3": "1"},
    ]
    frame = table(spark, "allbatters", [{**CARD, "retroid": str(i), **c} for i, c in enumerate(cards)])
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    frame.write.saveAsTable("padded_cards", mode="overwrite", path=str(tmp_path / "catalog"))
    frame.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(str(tmp_path / "allbatters"))
    for source in (
        Tables.from_catalog(spark, {"allbatters": "padded_cards"}),
        Tables.from_directory(spark, str(tmp_path), "csv"),
    ):
        found = position_slots(source.cards, "C")
        assert sorted((r.retroid, r.rg) for r in found.collect()) == [("0", 2.0), ("1", 3.0), ("2", 4.0)]
        text = found._jdf.queryExecution().executedPlan().toString()
        pushed = text.split("PushedFilters: ")[1].splitlines()[0]
        assert "GreaterThanOrEqual(pos1,C)" in pushed and "LessThan(pos1,C!)" in pushed, pushed
    spark.sql("DROP TABLE padded_cards")
    spark.conf.unset("spark.sql.maxMetadataStringLength")


# --- stored stages --------------------------------------------------------------


def files_under(path):
    return [f for f in path.rglob("*") if f.is_file()]


def test_a_stage_is_stored_once_for_its_plan_and_files(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(10).write.parquet(source)
    store = d.StageStore(str(tmp_path / "shared"))

    def total():
        return store.keep(spark.read.parquet(source).groupBy().agg(F.sum("id").alias("s")))

    first = total()
    held = len(files_under(tmp_path / "shared"))
    assert f"{tmp_path}/shared/stages/" in first.inputFiles()[0]
    assert total() is first and len(files_under(tmp_path / "shared")) == held
    assert store.keep(spark.read.parquet(source).groupBy().agg(F.max("id").alias("s"))) is not first
    assert first.first()[0] == 45
    # other rows in the same place are other inputs
    spark.range(20).write.mode("overwrite").parquet(source)
    assert total().first()[0] == 190
    store.clear()
    assert not files_under(tmp_path / "shared") and total().first()[0] == 190


def test_without_a_folder_spark_holds_the_stage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(d, "named_folder", lambda spark: None)
    source = str(tmp_path / "source")
    spark.range(10).write.parquet(source)
    store = d.StageStore()

    def total():
        return store.keep(spark.read.parquet(source).groupBy().agg(F.sum("id").alias("s")))

    first = total()
    assert first.is_cached and total() is first and first.first()[0] == 45
    spark.range(20).write.mode("overwrite").parquet(source)
    again = total()
    assert again.first()[0] == 190
    store.clear()
    assert not again.is_cached and not store.stages


def test_a_session_has_one_store(spark):
    assert d.store_of(spark) is d.store_of(spark.range(1).sparkSession)


def test_reports_share_the_sessions_stages_until_closed(spark, stored):
    one, other = (
        FieldingWinShares(Tables.from_directory(spark, stored, declared=True)) for _ in range(2)
    )
    assert one.codes.count() > 0
    held = sum(map(len, d.store_of(spark).stages.values()))
    assert other.codes.count() > 0 and sum(map(len, d.store_of(spark).stages.values())) == held
    one.close()
    assert not d.store_of(spark).stages
    assert one.codes.count() > 0  # stored anew
    one.close()


def test_sample_people_keys_are_unique(spark):
    people = SampleTables(spark, SF_DIR).people
    assert len(by(people, "key_retro")) == 125


def test_schemas_cover_every_table():
    assert len(DDL) == 8 + len(POSITIONS) and all(schema(n).names for n in DDL)
    assert len(schema("events").names) == 35


def test_empty_tables_give_empty_reports(spark):
    frames = {n: table(spark, n, []) for n in DDL}
    assert standard_pitching(Tables.from_frames(frames), 1900, 2100).count() == 0

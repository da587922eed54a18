"""Sample tables as Spark derives them, against the views that their twins start from."""

import re
from datetime import datetime

import pytest

import __spark_entry__ as entry
from statline import standard_pitching
from statline.operators.pitching import events_in_years
from statline.sources.durable import StageStore, store_of
from statline.sources.sample import VIEWS, SampleTables
from statline.sources.tables import conform

HUGE = 8000  # bytes of a method that the JVM does not compile

NULL_AT = range(7)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Orders and lines with repeated, negative and missing values."""
    path = str(tmp_path_factory.mktemp("odd"))
    orders = [
        (i % 40 - 5, None if i % 11 == 0 else i * 13 - 90,
         None if i % 13 == 0 else datetime(1994 + i % 8, 1 + i % 12, 1 + i % 28, i % 24))
        for i in range(90)
    ]
    lines = []
    for i in range(1500):
        row = [i % 44 - 6, i * 7 - 300, i * 5 % 131 - 20, 1 + i % 7, float(i * 3 % 50)]
        if i % 9 in NULL_AT and i % 4 == 0:
            row[i % 9 % 5] = None
        lines.append(tuple(row))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz") \
        .selectExpr("o_orderkey", "o_custkey", "cast(o_orderdate as timestamp) o_orderdate") \
        .write.parquet(f"{path}/orders.parquet")
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(lines, names).write.parquet(f"{path}/lineitem.parquet")
    return path


def same_rows(df, by_statement):
    """Whether a table has the rows of its views in :data:`VIEWS`, which the twins start from."""
    rows = [sorted(repr(tuple(r)) for r in x.select(*[f"`{c}`" for c in df.columns]).collect())
            for x in (df, by_statement)]
    assert rows[0] == rows[1] and rows[0]


def subtrees(df, capsys):
    """(its operators, largest method in bytes) of every piece of generated code."""
    df.explain("codegen")
    pieces = re.split(r"== Subtree \d+ / \d+ \(maxMethodCodeSize:", capsys.readouterr().out)[1:]
    found = []
    for piece in pieces:
        lines = piece.split("Generated code:")[0].splitlines()
        own = re.match(r"\*\(\d+\)", lines[1]).group()
        found.append(("\n".join(x for x in lines if own in x), int(piece.split(";")[0])))
    return found


def test_plays_of_odd_rows(spark, odd):
    sample = SampleTables(spark, odd)
    by_statement = conform(sample._view("fx_events", VIEWS), "events", trimmed=True)
    same_rows(sample.events, by_statement)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
@pytest.mark.parametrize("job", [
    lambda t: events_in_years(t.events, 1996, 1999), lambda t: standard_pitching(t),
])
def test_code_of_plays_is_compiled(spark, capsys, job, threshold):
    """The JVM interprets methods beyond 8,000 bytes, which took most of these jobs' time."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": threshold}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = subtrees(job(SampleTables(spark, "/root/testdata/sf0.001")), capsys)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    over_lines = [size for plan, size in found if "l_linenumber" in plan]
    assert over_lines and max(over_lines) < HUGE


@pytest.mark.parametrize("name", ["batting", "pitching", "fielding"])
def test_season_tables_from_sums_of_odd_rows(spark, odd, tmp_path, name):
    sample = SampleTables(spark, odd)
    store = StageStore(str(tmp_path))
    shared = sample.sharing(store.keep)
    same_rows(getattr(shared, name), getattr(sample, name))
    store.clear()
    same_rows(getattr(shared, name), getattr(sample, name))  # stored anew


def test_lines_are_read_for_one_stage_of_a_report(spark, odd, tmp_path):
    store = store_of(spark)
    folder, store.folder = store.folder, str(tmp_path)
    try:
        report = entry.JOBS["w16_fielding_win_shares"](SampleTables(spark, odd))
        stages = [s for same in store.stages.values() for s in same]
        lines = f"{odd}/lineitem.parquet"
        assert sum(any(lines in name for name, *_ in s.inputs) for s in stages) == 1
        assert lines not in report._jdf.queryExecution().executedPlan().toString()
    finally:
        store.folder = folder
        store.clear()

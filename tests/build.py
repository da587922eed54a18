"""Hand-made rows: only the columns a test cares about, defaults for the rest."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from statline.sources.schemas import schema

PLAY = {
    "game_id": "AAA199704010",
    "bat_home_id": 1,
    "away_team_id": "BBB",
    "pit_id": "p1",
    "resp_pit_id": "p1",
    "event_cd": 2,
    "h_cd": 0,
    "event_outs_ct": 0,
    "rbi_ct": 0,
    "bat_event_fl": "T",
    "ab_fl": "T",
    "sh_fl": "F",
    "sf_fl": "F",
    "dp_fl": "F",
    "battedball_cd": "",
    "resp_bat_hand_cd": "R",
    "bat_dest_id": 0,
    **{f"base{b}_run_id": "" for b in (1, 2, 3)},
    **{f"run{b}_resp_pit_id": "" for b in (1, 2, 3)},
    **{f"run{b}_dest_id": 0 for b in (1, 2, 3)},
    **{f"run{b}_{k}_fl": "F" for b in (1, 2, 3) for k in ("sb", "cs", "pk")},
}
GAME = {
    "yyyymmdd": "19970401",
    "homteam": "AAA",
    "visteam": "BBB",
    "homleague": "AL",
    "visleague": "AL",
    "parkid": "PK1",
    "homscore": 1,
    "visscore": 0,
    "homhr": 0,
    "vishr": 0,
}
CARD = {"year": 1998, "age": 25, "retroid": "x", "lastname": "L", "firstname": "F"}


def table(spark: SparkSession, name: str, rows: list[dict], defaults: dict | None = None):
    """A DataFrame of declared type; columns in neither row nor defaults are NULL."""
    kind = schema(name)

    def value(field: T.StructField, row: dict):
        v = row.get(field.name)
        return Decimal(str(v)) if isinstance(field.dataType, T.DecimalType) and v is not None else v

    full = [{**(defaults or {}), **row} for row in rows]
    return spark.createDataFrame([tuple(value(f, r) for f in kind) for r in full], kind)


def plays(spark: SparkSession, *rows: dict) -> DataFrame:
    return table(spark, "events", list(rows), PLAY)


def games(spark: SparkSession, *rows: dict) -> DataFrame:
    return table(spark, "gamelogs", list(rows), GAME)


def by(df: DataFrame, *keys: str) -> dict:
    """Rows as dicts under their key columns; a key may not repeat."""
    rows = [r.asDict() for r in df.collect()]
    out = {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
    assert len(out) == len(rows)
    return out

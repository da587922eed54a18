"""Columns and types of the base tables, in their order."""

from __future__ import annotations

from pyspark.sql import types as T

from statline.constants import CARD_SLOTS, POSITIONS


_BASES = (1, 2, 3)

EVENTS = [
    "game_id STRING",
    "bat_home_id INT",
    "away_team_id STRING",
    "pit_id STRING",
    "resp_pit_id STRING",
    *[f"run{b}_resp_pit_id STRING" for b in _BASES],
    "event_cd INT",
    "h_cd INT",
    "event_outs_ct INT",
    "rbi_ct BIGINT",
    "bat_dest_id BIGINT",
    *[f"run{b}_dest_id BIGINT" for b in _BASES],
    "bat_event_fl STRING",
    "ab_fl STRING",
    "sh_fl STRING",
    "sf_fl STRING",
    "dp_fl STRING",
    "battedball_cd STRING",
    "resp_bat_hand_cd STRING",
    *[f"base{b}_run_id STRING" for b in _BASES],
    *[f"run{b}_{kind}_fl STRING" for b in _BASES for kind in ("sb", "cs", "pk")],
]
GAMELOGS = [
    "yyyymmdd STRING",
    *[f"{side}team STRING" for side in ("hom", "vis")],
    *[f"{side}league STRING" for side in ("hom", "vis")],
    "parkid STRING",
    *[f"{who}id STRING" for who in ("homsp", "vissp", "winpit", "lospit", "svpit")],
    *[f"{side}{count} BIGINT" for count in ("score", "hr", "sh", "sf", "dp") for side in ("hom", "vis")],
]
PEOPLE = ["key_retro STRING", "name_last STRING", "name_first STRING"]
TEAMS = ["yearid INT", "lgid STRING", "teamidretro STRING", "teamidbr STRING"]
PARKCONFIG = [
    "year INT",
    "parkid STRING",
    "retrotm STRING",
    "lg STRING",
    *[f"{part} INT" for part in ("lf_dim", "cf_dim", "rf_dim", "lf_w", "cf_w", "rf_w")],
]
SEASON = ["year INT", "lg STRING", "tm STRING"]
BATTING = [
    *SEASON,
    "pid STRING",
    *[f"{s} BIGINT" for s in ("ab", "r", "h", "2b", "3b", "hr", "bb", "so", "hbp", "sh", "sf", "sb", "cs")],
]
PITCHING = [
    *SEASON,
    "name STRING",
    "ip DECIMAL(18,1)",
    *[f"{s} BIGINT" for s in ("w", "l", "gs", "bf", "h", "r", "er", "hr", "hbp", "bb", "so", "wp", "bk")],
]
FIELDING = [
    *SEASON,
    "name STRING",
    "name-additional STRING",
    *[f"{s} BIGINT" for s in ("inn", "po", "a", "e", "dp", "pb", "sb", "cs")],
]
CARDS = [
    "year INT",
    "age INT",
    "retroid STRING",
    "lastname STRING",
    "firstname STRING",
    *[f"{kind}{i} STRING" for i in range(1, CARD_SLOTS + 1) for kind in ("pos", "rg")],
]

DDL = {
    "events": EVENTS,
    "gamelogs": GAMELOGS,
    "people": PEOPLE,
    "teams": TEAMS,
    "parkconfig": PARKCONFIG,
    "batting": BATTING,
    "pitching": PITCHING,
    **{f"fielding_{pos}": FIELDING for pos in POSITIONS},
    "allbatters": CARDS,
}


def schema(name: str) -> T.StructType:
    fields = (field.rsplit(" ", 1) for field in DDL[name])
    return T.StructType.fromDDL(", ".join(f"`{column}` {kind}" for column, kind in fields))

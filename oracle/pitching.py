"""Pitching jobs as SQL."""

from __future__ import annotations

from statline.sources.sample import ctes

YEAR = "substr(game_id, 4, 4)"
TEAM = "if(bat_home_id = 1, away_team_id, substr(game_id, 1, 3))"
KEYS = f'{YEAR} AS "Year", resp_pit_id AS "RetroID", {TEAM} AS "Team"'

COUNTED = {
    "PA": "bat_event_fl = 'T'",
    "AB": "ab_fl = 'T'",
    "H": "h_cd > 0",
    "DB": "h_cd = 2",
    "TP": "h_cd = 3",
    "HR": "h_cd = 4",
    "BB": "event_cd IN (14, 15)",
    "SO": "event_cd = 3",
    "GDP": "dp_fl = 'T' AND battedball_cd = 'G'",
    "HBP": "event_cd = 16",
    "SH": "sh_fl = 'T'",
    "SF": "sf_fl = 'T'",
    "IBB": "event_cd = 15",
}


def with_(sql: str, *inputs: str, extra: str = "") -> str:
    return f"WITH {ctes(*inputs)}{', ' + extra if extra else ''}\n{sql}"


def half_up(num: str, den: str, scale: int) -> str:
    """A ratio rounded half up in whole units, then scaled."""
    p = 10**scale
    return f"CASE WHEN {den} > 0 THEN ((2*{p}*({num}) + ({den})) // (2*({den}))) / {p} END"


def games() -> str:
    seen = " UNION ".join(
        f'SELECT {YEAR} AS "Year", {TEAM} AS "Team", {who} AS "RetroID", game_id '
        f"FROM fx_events WHERE {who} IS NOT NULL"
        for who in ("pit_id", "resp_pit_id")
    )
    return (
        f'SELECT "Year", "Team", "RetroID", count(*) AS "G" FROM ({seen}) '
        "WHERE trim(\"RetroID\") <> '' GROUP BY ALL"
    )


def _years(column: str, start: str | None, end: str | None) -> str:
    return "true" if start is None else f"{column} BETWEEN '{start}' AND '{end}'"


def decisions(start: str | None, end: str | None) -> str:
    sides = (("homteam", "homspid", ">", "<"), ("visteam", "visspid", "<", ">"))
    rows = []
    for team, starter, won, lost in sides:
        for who, kind, test in (
            (starter, "GS", "true"),
            ("winpitid", "W", f"homscore {won} visscore"),
            ("lospitid", "L", f"homscore {lost} visscore"),
            ("svpitid", "SV", f"homscore {won} visscore"),
        ):
            rows.append(
                f'SELECT substr(yyyymmdd, 1, 4) AS "Year", {team} AS "Team", '
                f"{who} AS \"RetroID\", '{kind}' AS kind FROM fx_gamelogs WHERE {test}"
            )
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = '{k}') AS \"{k}\"" for k in ("GS", "W", "L", "SV")
    )
    return (
        f'SELECT "Year", "Team", "RetroID", {counts} FROM ({" UNION ALL ".join(rows)}) '
        f"WHERE rtrim(\"RetroID\") <> '' AND {_years('\"Year\"', start, end)} GROUP BY ALL"
    )


def pitching() -> str:
    def block(sfx: str, test: str) -> list[str]:
        out = [
            f'count(*) FILTER (WHERE {cond} AND {test}) AS "{name}{sfx}"'
            for name, cond in COUNTED.items()
        ]
        return [*out, f'sum(if({test}, rbi_ct, 0))::BIGINT AS "RBI{sfx}"']

    columns = block("", "true")
    columns.append('sum(event_outs_ct)::BIGINT AS "Outs"')
    for hand in "LR":
        columns += block(f"_{hand}", f"coalesce(resp_bat_hand_cd = '{hand}', false)")
    return (
        f'SELECT {YEAR} AS "Year", resp_pit_id AS "Resp_pit_id", {TEAM} AS "Team", '
        f"{', '.join(columns)} FROM fx_events GROUP BY ALL"
    )


def running(bare_pickoff: str) -> str:
    """``bare_pickoff``: test for a pickoff that is no caught stealing, ``{b}`` the base."""
    rows = []
    for base, to in ((1, "2"), (2, "3"), (3, "H")):
        tests = {
            f"SB{to}": f"run{base}_sb_fl = 'T'",
            f"CS{to}": f"run{base}_cs_fl = 'T' AND run{base}_pk_fl IN ('F', 'T')",
            "PkO": bare_pickoff.format(b=base),
            "POCS": f"run{base}_cs_fl = 'T' AND run{base}_pk_fl = 'T'",
        }
        rows += [
            f"SELECT {KEYS}, '{kind}' AS kind FROM fx_events WHERE {test}"
            for kind, test in tests.items()
        ]
    plain = ("SB2", "SB3", "SBH", "CS2", "CS3", "CSH", "POCS")
    counts = [f"count(*) FILTER (WHERE kind = '{k}') AS \"{k}\"" for k in plain]
    counts += [
        "count(*) FILTER (WHERE kind LIKE 'SB%') AS \"SB\"",
        "count(*) FILTER (WHERE kind LIKE 'CS%') AS \"CS\"",
        "count(*) FILTER (WHERE kind IN ('PkO', 'POCS')) AS \"PkO\"",
    ]
    return (
        f'SELECT "Year", "RetroID", "Team", {", ".join(counts)} '
        f"FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL"
    )


PICKOFF = {
    "as_caught": "run{b}_cs_fl = 'T' AND run{b}_pk_fl = 'F'",
    "flag": "run{b}_cs_fl = 'F' AND run{b}_pk_fl = 'T'",
}


def errors() -> str:
    return (
        f'SELECT {KEYS}, count(*) AS "ROE" FROM fx_events '
        "WHERE bat_event_fl = 'T' AND event_cd = 18 GROUP BY ALL"
    )


def chances() -> str:
    rows = [
        f"SELECT {KEYS} FROM fx_events WHERE bat_event_fl = 'T' "
        f"AND rtrim(base{b}_run_id) <> '' AND rtrim(base{b + 1}_run_id) = ''"
        for b in (1, 2)
    ]
    return f'SELECT *, count(*) AS "SBO" FROM ({" UNION ALL ".join(rows)}) GROUP BY ALL'


def runs() -> str:
    rows = [
        f'SELECT {YEAR} AS "Year", {who} AS "RetroID", {TEAM} AS "Team", {dest} AS dest '
        f"FROM fx_events WHERE {dest} >= 4"
        for who, dest in (
            ("run1_resp_pit_id", "run1_dest_id"),
            ("run2_resp_pit_id", "run2_dest_id"),
            ("run3_resp_pit_id", "run3_dest_id"),
            ("resp_pit_id", "bat_dest_id"),
        )
    ]
    return (
        'SELECT "Year", "RetroID", "Team", count(*) AS "R", '
        'count(*) FILTER (WHERE dest IN (4, 6)) AS "ER" '
        f"FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL"
    )


def report(start: str | None, end: str | None, pickoff: str = "as_caught") -> str:
    def rates(sfx: str) -> list[str]:
        h, db, tp, hr, ab, bb, hbp, sf = (
            f'e."{c}{sfx}"' for c in ("H", "DB", "TP", "HR", "AB", "BB", "HBP", "SF")
        )
        bases = f"{h} + {db} + 2*{tp} + 3*{hr}"
        return [
            f'{half_up(h, ab, 3)} AS "AVG{sfx}"',
            f'{half_up(f"{h}+{bb}+{hbp}", f"({ab}+{bb}+{hbp}+{sf})", 3)} AS "OBP{sfx}"',
            f'{half_up(bases, ab, 3)} AS "SLG{sfx}"',
            f'coalesce({bases}, 0) AS "TB{sfx}"',
        ]

    def zero(alias: str, *names: str) -> list[str]:
        return [f'coalesce({alias}."{n}", 0) AS "{n}"' for n in names]

    counts = ["PA", "AB", "H", "DB", "TP", "HR", "RBI", "BB", "SO", "GDP", "HBP", "SH", "SF", "IBB"]
    tries = 's."SB" + s."CS"'
    columns = [
        'g."Year"', 'g."Team"', "name_last", "name_first", 'g."RetroID"', 'g."G"',
        *zero("d", "GS", "W", "L", "SV"), *zero("r", "R", "ER"),
        *zero("e", "Outs", *counts),
        'coalesce((10 * (e."Outs" // 3) + e."Outs" % 3) / 10, 0.0) AS "IP"',
        f'CASE WHEN r."R" IS NOT NULL THEN {half_up("27*r.\"ER\"", "e.\"Outs\"", 2)} END AS "ERA"',
        'coalesce(e."Outs" = 0 AND r."ER" > 0, false) AS "ERA_is_inf"',
        *rates(""), *rates("_L"), *rates("_R"),
        *zero("e", *[f"{c}_{h}" for c in counts for h in "LR"]),
        "'' AS \"PlatoonStats\"", "'' AS \"Baserunning\"",
        f'{half_up("100*e.\"PA_L\"", "e.\"PA\"", 0)}::DOUBLE AS "PctVsLHP"',
        *zero("s", "SB", "CS", "SB2", "CS2", "SB3", "CS3", "SBH", "CSH", "PkO", "POCS"),
        'coalesce(s."SB", 0) AS "SB_run"', 'coalesce(s."CS", 0) AS "CS_run"',
        f'{half_up("100*s.\"SB\"", f"({tries})", 1)} AS "SBPct"',
        *zero("o", "SBO"),
        half_up(f"100*(coalesce({tries}, 0))", 'o."SBO"', 2) + ' AS "JumpPct"',
    ]
    parts = {
        "g": games(), "d": decisions(start, end), "e": pitching(),
        "s": running(PICKOFF[pickoff]), "o": chances(), "r": runs(),
    }
    extra = ", ".join(f"part_{k} AS ({v})" for k, v in parts.items())

    def on(alias: str, who: str = "RetroID") -> str:
        return (
            f'LEFT JOIN part_{alias} {alias} ON g."Year" = {alias}."Year" '
            f'AND g."Team" = {alias}."Team" AND g."RetroID" = {alias}."{who}"'
        )

    joins = [on("d"), on("r"), on("s"), on("e", "Resp_pit_id"), on("o")]
    sql = (
        f"SELECT {', '.join(columns)} FROM part_g g {' '.join(joins)} "
        'JOIN fx_people p ON p.key_retro = g."RetroID" '
        f"WHERE p.name_last IS NOT NULL AND {_years('g.\"Year\"', start, end)} "
        'ORDER BY g."Year", g."Team", name_last, name_first, g."RetroID"'
    )
    return with_(sql, "fx_events", "fx_gamelogs", "fx_people", extra=extra)


def statements() -> dict[str, str]:
    every = (None, None)
    return {
        "p1_events_in_years": with_(
            f"SELECT * FROM fx_events WHERE {YEAR} >= '1996' AND {YEAR} <= '1999'", "fx_events"
        ),
        "p2_games_pitched": with_(games(), "fx_events"),
        "p3_game_log_decisions": with_(decisions(*every), "fx_gamelogs"),
        "p4_pitching_events": with_(pitching(), "fx_events"),
        "p5_running_game": with_(running(PICKOFF["as_caught"]), "fx_events"),
        "p5_running_game_pickoff_flags": with_(running(PICKOFF["flag"]), "fx_events"),
        "p6_reached_on_error": with_(errors(), "fx_events"),
        "p7_steal_opportunities": with_(chances(), "fx_events"),
        "p8_runs_allowed": with_(runs(), "fx_events"),
        "p9_standard_pitching": report(*every),
        "p9_standard_pitching_one_season": report("1997", "1997"),
    }

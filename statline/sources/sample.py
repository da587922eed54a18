"""Base tables derived from a generic orders data set.

No real records ship with the library. These expressions turn order lines into
plays, orders into games, and sums of both into season tables: arithmetic
patterns with every sentinel the jobs must handle. They use only SQL that
Spark and DuckDB read alike, so that checks outside Spark can start from the
same rows (:func:`ctes`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from statline.constants import POSITIONS
from statline.sources.durable import Keep
from statline.sources.tables import Tables, conform

BASE_TABLES = ("lineitem", "orders", "nation", "region")


@dataclass(frozen=True)
class View:
    """``SELECT keep, columns FROM source WHERE where GROUP BY group``."""

    source: str
    columns: dict[str, str]
    needs: tuple[str, ...]
    keep: str = ""
    where: str = ""
    group: str = ""
    distinct: bool = False


def _ymd(d: str) -> str:
    return f"cast(year({d})*10000+month({d})*100+day({d}) as varchar(8))"


def _two(n: str) -> str:
    return f"lpad(cast({n} as varchar(2)),2,'0')"


def _team(n: str) -> str:
    return f"'T' || {_two(n)}"


def _br_team(n: str) -> str:
    return f"'B' || {_two(n)}"


def _league(n: str) -> str:
    return f"case when {n} % 2 = 0 then 'AL' else 'NL' end"


def _person(team: str, slot: str) -> str:
    return f"'p' || {_two(team)} || 's' || cast({slot} as varchar(1))"


def _flag(condition: str) -> str:
    return f"case when {condition} then 'T' else 'F' end"


def _count(condition: str) -> str:
    return f"sum(case when {condition} then 1 else 0 end)"


# event codes of plays by the play number modulo 100: (first number past the band, code)
EVENT_BANDS = (
    (18, 3), (27, 14), (28, 15), (29, 16), (31, 18), (46, 20), (51, 21), (52, 22), (55, 23),
    (60, 4), (63, 6), (65, 8), (100, 2),
)


def _event_code() -> str:
    arms = " ".join(f"when m < {high} then {code}" for high, code in EVENT_BANDS)
    return f"case {arms} end"


def _is(*codes: int) -> str:
    """Test of a play's event code on its number, which filters can repeat cheaply."""
    bands, low = [], 0
    for high, code in EVENT_BANDS:
        if code in codes and bands and bands[-1][1] == low:
            bands[-1] = (bands[-1][0], high)
        elif code in codes:
            bands.append((low, high))
        low = high
    tests = [f"m >= {a} and m < {b}" if a else f"m < {b}" for a, b in bands]
    return f"({' or '.join(tests)})"


def _card_slot(i: int) -> dict[str, str]:
    positions = ("C", "1B", "2B", "3B", "SS", "LF", "CF", "RF")  # and none
    cases = " ".join(f"when {n} then '{name}'" for n, name in enumerate(positions))
    return {
        f"pos{i}": f"case cast((c + {i}*y) % 9 as int) {cases} end",
        f"rg{i}": f"cast(1 + (c*{i}+y) % 5 as varchar(1))",
    }


_AWAY = "(o_custkey % 25 + 1 + o_orderkey % 24) % 25"
_FIELDED = {
    "inn": "sum(qty*3)",
    "po": "sum(qty)",
    "a": "sum(qty%12)",
    "e": _count("qty%9=0"),
    "dp": _count("qty%6=0"),
    "pb": _count("qty%15=0"),
    "sb": "sum(qty%3)",
    "cs": _count("qty%4=1"),
}
_PLAYER_KEYS = {"year": "year", "lg": "lg", "tm": "tm"}

VIEWS: dict[str, View] = {
    "fx_play": View(
        "{lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey",
        {
            "o_custkey": "o.o_custkey",
            "o_orderdate": "o.o_orderdate",
            "hm": "o.o_custkey % 25",
            "aw": "(o.o_custkey % 25 + 1 + o.o_orderkey % 24) % 25",
            "qty": "cast(l.l_quantity as bigint)",
            "k": "(l.l_orderkey*31 + l.l_linenumber*17 + l.l_partkey*7 + l.l_suppkey*3) % 1000",
        },
        ("lineitem", "orders"),
        keep="l.*",
    ),
    "fx_play2": View(
        "{fx_play} p",
        {
            "fld": "case when l_linenumber % 2 = 1 then aw else hm end",
            "m": "k % 100",
            **{f"q{n}": f"qty % {n}" for n in (3, 4, 5, 20)},
        },
        ("fx_play",),
        keep="p.*",
    ),
    "fx_play3": View(
        "{fx_play2} p",
        # home, away codes, the start of the fielding side's person ids, kinds of play
        {
            "home": _team("hm"),
            "away": _team("aw"),
            "side": f"'p' || {_two('fld')} || 's'",
            "arm": "l_suppkey % 5",
            "ball_out": _is(2),
            "homer": _is(23),
            "caught": _is(6),
        },
        ("fx_play2",),
        keep="p.*",
    ),
    "fx_events": View(
        "{fx_play3} p",
        {
            "game_id": f"home || {_ymd('o_orderdate')} || cast(l_orderkey % 10 as varchar(1))",
            "bat_home_id": "l_linenumber % 2",
            "away_team_id": "away",
            "pit_id": "case when k = 7 then null else side || cast(arm as varchar(1)) end",
            "resp_pit_id": "case when k = 11 then null when k = 13 then ' ' "
            "else side || cast((case when k % 50 = 3 then (l_suppkey + 1) % 5 else arm end) "
            "as varchar(1)) end",
            "run1_resp_pit_id": "side || cast((l_suppkey + qty) % 5 as varchar(1))",
            "run2_resp_pit_id": "side || cast((l_suppkey + qty + 1) % 5 as varchar(1))",
            "run3_resp_pit_id": "side || cast((l_suppkey + 2) % 5 as varchar(1))",
            "event_cd": _event_code(),
            "bat_event_fl": _flag(f"not {_is(4, 6, 8)}"),
            "h_cd": f"case when not {_is(20, 21, 22, 23)} then 0 when {_is(20)} then 1 "
            f"when {_is(21)} then 2 when {_is(22)} then 3 else 4 end",
            "sh_fl": _flag(f"ball_out and q20 = 1"),
            "sf_fl": _flag(f"ball_out and q20 = 2"),
            "ab_fl": _flag(
                f"{_is(3, 18, 20, 21, 22, 23)} or (ball_out and q20 not in (1,2))"
            ),
            "dp_fl": _flag(f"ball_out and qty % 9 = 0"),
            "battedball_cd": f"case when ball_out "
            "then (case when q3 = 0 then 'G' else 'F' end) else '' end",
            "rbi_ct": f"case when homer then 1 + q4 "
            f"when {_is(20, 21, 22)} then qty % 2 else 0 end",
            "event_outs_ct": f"case when {_is(3, 6, 8)} then 1 when ball_out "
            "then (case when qty % 9 = 0 then 2 else 1 end) else 0 end",
            "resp_bat_hand_cd": "case when l_partkey % 5 < 2 then 'L' "
            "when l_partkey % 5 < 4 then 'R' else 'B' end",
            "base1_run_id": "case when q3 = 0 then 'r1' else '' end",
            "base2_run_id": "case when q4 = 0 then 'r2' else '' end",
            "base3_run_id": "case when q5 = 0 then 'r3' else '' end",
            **{
                f"run{b}_sb_fl": _flag(f"{_is(4)} and q{mod} = 0")
                for b, mod in ((1, 3), (2, 4), (3, 5))
            },
            **{f"run{b}_cs_fl": _flag(f"caught and q3 = {b - 1}") for b in (1, 2, 3)},
            **{
                f"run{b}_pk_fl": _flag(f"{_is(6, 8)} and qty % {mod} = 0")
                for b, mod in ((1, 2), (2, 4), (3, 8))
            },
            "bat_dest_id": f"case when homer then 4 + q3 "
            f"when {_is(20)} then 1 else 0 end",
            "run1_dest_id": f"case when q3 = 0 and {_is(22, 23)} "
            "then 4 + qty % 2 else 0 end",
            "run2_dest_id": f"case when q4 = 0 and {_is(21, 22, 23)} "
            "then 4 + q3 else 0 end",
            "run3_dest_id": f"case when q5 = 0 and {_is(20, 21, 22, 23)} "
            "then 4 + q4 else 0 end",
        },
        ("fx_play3",),
    ),
    "fx_gl0": View(
        "{orders} o",
        {
            "hm": "o_custkey % 25",
            "aw": _AWAY,
            "hs": "(o_orderkey*7+o_custkey*3) % 10",
            "vs": "(o_orderkey*11+o_custkey) % 10",
        },
        ("orders",),
        keep="o.*",
    ),
    "fx_gamelogs": View(
        "{fx_gl0} g",
        {
            "yyyymmdd": _ymd("o_orderdate"),
            "homteam": _team("hm"),
            "visteam": _team("aw"),
            "homleague": _league("hm"),
            "visleague": _league("aw"),
            "homscore": "hs",
            "visscore": "vs",
            "homhr": "o_orderkey % 3",
            "vishr": "o_custkey % 3",
            "homsh": "case when o_orderkey % 17 = 0 then null else o_orderkey % 4 - 1 end",
            "vissh": "case when o_orderkey % 19 = 0 then null else o_custkey % 4 - 1 end",
            "homsf": "o_orderkey % 5 - 1",
            "vissf": "o_custkey % 5 - 1",
            "homdp": "o_orderkey % 6 - 1",
            "visdp": "o_custkey % 6 - 1",
            "parkid": f"'PK' || {_two('hm')} "
            "|| (case when o_orderkey % 40 = 0 then 'B' else 'A' end)",
            "homspid": _person("hm", "o_orderkey % 5"),
            "visspid": _person("aw", "o_custkey % 5"),
            "winpitid": f"case when hs>vs then {_person('hm', '(o_orderkey+1) % 5')} "
            f"when vs>hs then {_person('aw', '(o_orderkey+1) % 5')} else '' end",
            "lospitid": f"case when hs>vs then {_person('aw', '(o_orderkey+2) % 5')} "
            f"when vs>hs then {_person('hm', '(o_orderkey+2) % 5')} else '' end",
            "svpitid": "case when o_orderkey % 2 = 0 then '' "
            f"when hs>vs then {_person('hm', '(o_orderkey+3) % 5')} "
            f"when vs>hs then {_person('aw', '(o_orderkey+3) % 5')} else null end",
        },
        ("fx_gl0",),
    ),
    # everybody who started a home game; named after a nation and a region
    "fx_starters": View(
        "{orders} o", {"team": "o_custkey % 25", "slot": "o_orderkey % 5"}, ("orders",),
        distinct=True,
    ),
    "fx_people": View(
        "{fx_starters} s join {nation} n on n.n_nationkey = s.team "
        "join {region} r on r.r_regionkey = s.slot",
        {
            "key_retro": _person("team", "slot"),
            "name_last": "case when team = 24 and slot = 4 then null else n_name end",
            "name_first": "r_name",
        },
        ("fx_starters", "nation", "region"),
    ),
    # every season a team had a home game in
    "fx_seasons": View(
        "{orders} o", {"yr": "year(o_orderdate)", "n": "o_custkey % 25"}, ("orders",),
        distinct=True,
    ),
    "fx_teams": View(
        "{fx_seasons} y",
        {
            "yearid": "yr",
            "lgid": _league("n"),
            "teamidretro": _team("n"),
            "teamidbr": _br_team("n"),
        },
        ("fx_seasons",),
    ),
    "fx_parkconfig": View(
        "{fx_seasons} y",
        {
            "year": "yr",
            "parkid": f"'PK' || {_two('n')} || 'A'",
            "retrotm": _team("n"),
            "lg": _league("n"),
            "lf_dim": "330 + n + (case when yr >= 1998 and n % 3 = 0 then 5 else 0 end)",
            "cf_dim": "400",
            "rf_dim": "325 + n",
            "lf_w": "8",
            "cf_w": "8 + yr % 2 * (case when n % 7 = 0 then 1 else 0 end)",
            "rf_w": "10",
        },
        ("fx_seasons",),
    ),
    "fx_ps": View(
        "{fx_play} p",
        {
            "year": "year(o_orderdate)",
            "lg": "case when l_orderkey % 53 = 0 then 'MLB' "
            "else (case when l_suppkey % 25 % 2 = 0 then 'AL' else 'NL' end) end",
            "tm": f"case when l_orderkey % 53 = 0 then 'TOT' else {_br_team('l_suppkey % 25')} end",
            "pid": f"'b' || {_two('l_suppkey % 25')} || 'x' || cast(l_linenumber as varchar(1))",
            "slot": "l_linenumber",
        },
        ("fx_play",),
        keep="p.*",
    ),
    "fx_batting": View(
        "{fx_ps} p",
        {
            **_PLAYER_KEYS,
            "pid": "pid",
            "ab": "sum(qty)",
            "r": "sum(qty%7)",
            "h": "sum(qty%14)",
            "2b": "sum(qty%4)",
            "3b": _count("qty%10=0"),
            "hr": "sum(case when qty%4=0 then 3 else 0 end)",
            "bb": "sum(qty%5)",
            "so": "sum(qty%8)",
            "hbp": _count("qty%9=0"),
            "sh": _count("qty%11=0"),
            "sf": _count("qty%13=0"),
            "sb": "sum(qty%3)",
            "cs": _count("qty%6=0"),
        },
        ("fx_ps",),
        group="year, lg, tm, pid",
    ),
    "fx_pitching": View(
        "{fx_ps} p",
        {
            **_PLAYER_KEYS,
            "name": "pid || (case when slot % 3 = 0 then '*' else '' end)",
            "w": _count("k%2=0"),
            "l": _count("k%2=1"),
            "gs": "count(*)",
            "ip": "cast((sum(qty) - sum(qty) % 3) / 3 as decimal(10,1)) "
            "+ cast(sum(qty) % 3 as decimal(10,1)) * cast(0.1 as decimal(2,1))",
            "bf": f"sum(qty + qty%14 + qty%5) + {_count('qty%9=0')}",
            "h": "sum((qty+k)%14)",
            "r": "sum((qty+k)%7)",
            "er": "sum((qty+k)%6)",
            "hr": "sum(case when (qty+k)%4=0 then 3 else 0 end)",
            "hbp": f"nullif({_count('(qty+k)%9=0')},0)",
            "bb": "sum((qty+k)%5)",
            "so": "sum((qty+k)%4)",
            "wp": _count("k%30=0"),
            "bk": _count("k%90=0"),
        },
        ("fx_ps",),
        group="year, lg, tm, pid, slot",
    ),
    **{
        f"fx_fielding_{pos}": View(
            "{fx_ps} p",
            {**_PLAYER_KEYS, "name": "pid", "name-additional": "pid", **_FIELDED},
            ("fx_ps",),
            where=f"l_partkey % 7 = {index}",
            group="year, lg, tm, pid",
        )
        for index, pos in enumerate(POSITIONS)
    },
    # the seven positions in one pass
    "fx_fielding": View(
        "{fx_ps} p",
        {
            **_PLAYER_KEYS,
            "name": "pid",
            "name-additional": "pid",
            **_FIELDED,
            "pos": "case l_partkey % 7 "
            + " ".join(f"when {i} then '{p}'" for i, p in enumerate(POSITIONS))
            + " end",
        },
        ("fx_ps",),
        group="year, lg, tm, pid, l_partkey % 7",
    ),
    "fx_ab0": View(
        "{orders} o", {"c": "o_custkey", "y": "year(o_orderdate)"}, ("orders",), distinct=True
    ),
    "fx_allbatters": View(
        "{fx_ab0} a",
        {
            "year": "y",
            "retroid": "'b' || lpad(cast(c as varchar(19)),19,'0')",
            "lastname": "'Last' || cast(c % 97 as varchar(2))",
            "firstname": "'First' || cast(c % 13 as varchar(2))",
            "age": "case when c % 101 = 0 then 55 else 17 + c % 20 + (y - 1995) end",
            **{k: v for i in range(1, 9) for k, v in _card_slot(i).items()},
        },
        ("fx_ab0",),
    ),
}


def _codes_by_number() -> str:
    """Event codes of the play numbers 0 to 99, as an array."""
    return f"array({','.join(str(next(c for top, c in EVENT_BANDS if m < top)) for m in range(100))})"


def _coded(expr: str) -> str:
    """An expression of plays on the event code instead of the play number's bands."""
    for codes in ((3, 18, 20, 21, 22, 23), (20, 21, 22, 23), (20, 21, 22), (21, 22, 23), (4, 6, 8),
                  (3, 6, 8), (22, 23), (6, 8), (4,), (20,), (21,), (22,)):
        expr = expr.replace(_is(*codes), f"(code in ({','.join(map(str, codes))}))")
    return expr


# The same plays as Spark derives them. What an order says alone is derived before lines meet
# it, so that bounds on seasons reach the orders; the event code is looked up once a play. One
# play's code then stays far below the 8,000 bytes beyond which the JVM only interprets it.
SPARK_VIEWS: dict[str, View] = {
    **VIEWS,
    "fx_game0": View(
        "{orders} o", {"hm": "o_custkey % 25", "aw": _AWAY}, ("orders",),
        keep="o_orderkey, o_orderdate",
    ),
    "fx_game": View(
        "{fx_game0} g",
        {
            "game_id": f"{_team('hm')} || {_ymd('o_orderdate')} "
            "|| cast(o_orderkey % 10 as varchar(1))",
            "home": _team("hm"),
            "away": _team("aw"),
        },
        ("fx_game0",),
        keep="o_orderkey",
    ),
    "fx_line": View(
        "{lineitem} l join {fx_game} g on l.l_orderkey = g.o_orderkey",
        {
            "qty": VIEWS["fx_play"].columns["qty"],
            "k": VIEWS["fx_play"].columns["k"],
            "arm": VIEWS["fx_play3"].columns["arm"],
        },
        ("lineitem", "fx_game"),
        keep="l_linenumber, l_partkey, l_suppkey, game_id, home, away",
    ),
    "fx_line2": View(
        "{fx_line} l",
        {
            "m": VIEWS["fx_play2"].columns["m"],
            # a team's id ends in the two digits that its pitchers' ids begin with
            "side": "'p' || substring(case when l_linenumber % 2 = 1 then away else home end, 2, 2) "
            "|| 's'",
            **{n: f"qty % {n[1:]}" for n in ("q3", "q4", "q5", "q20")},
        },
        ("fx_line",),
        keep="l.*",
    ),
    "fx_line3": View(
        "{fx_line2} l",
        # numbers below zero fall into the first band; none where the number is unknown
        {"code": f"get({_codes_by_number()}, cast(case when m < 0 then 0 else m end as int))"},
        ("fx_line2",),
        keep="l.*",
    ),
    "fx_line4": View(
        "{fx_line3} l",
        {
            "ball_out": "code = 2",
            "homer": "code = 23",
            "caught": "code = 6",
        },
        ("fx_line3",),
        keep="l.*",
    ),
    "fx_events": View(
        "{fx_line4} p",
        {
            **{name: _coded(expr) for name, expr in VIEWS["fx_events"].columns.items()},
            "game_id": "game_id",
            "event_cd": "code",
        },
        ("fx_line4",),
    ),
}


def _sums_in(expr: str) -> list[str]:
    """Every sum or count in an expression, as written."""
    found, at = [], 0
    while begins := re.compile(r"\b(sum|count)\(").search(expr, at):
        depth, at = 1, begins.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(expr[at], 0)
            at += 1
        found.append(expr[begins.start() : at])
    return found


# The season tables once more, from one grouping of the plays finer than any of theirs: each
# of their sums is the sum of its parts.
SEASON_TABLES = ("fx_batting", "fx_pitching", "fx_fielding")
SEASON_SUMS = {
    expr: f"sum{i}"
    for i, expr in enumerate(
        dict.fromkeys(
            s for name in SEASON_TABLES for e in VIEWS[name].columns.values() for s in _sums_in(e)
        )
    )
}
SPARK_VIEWS["fx_season_sums"] = View(
    "{fx_ps} p",
    {
        **_PLAYER_KEYS,
        "pid": "pid",
        "slot": "slot",
        "part": "l_partkey % 7",
        **{name: expr for expr, name in SEASON_SUMS.items()},
    },
    ("fx_ps",),
    group="year, lg, tm, pid, slot, l_partkey % 7",
)


def _from_sums(expr: str) -> str:
    for part in sorted(_sums_in(expr), key=len, reverse=True):
        expr = expr.replace(part, f"sum({SEASON_SUMS[part]})")
    return expr.replace("l_partkey % 7", "part")


FROM_SUMS: dict[str, View] = {
    name: View(
        "{fx_season_sums} s",
        {column: _from_sums(expr) for column, expr in VIEWS[name].columns.items()},
        ("fx_season_sums",),
        group=_from_sums(VIEWS[name].group),
    )
    for name in SEASON_TABLES
}


def select(name: str, quote: str, ref, views: dict[str, View] = VIEWS) -> str:
    """The SELECT of a view, with ``ref(table)`` naming its inputs."""
    view = views[name]
    columns = [f"{expr} AS {quote}{alias}{quote}" for alias, expr in view.columns.items()]
    items = ([view.keep] if view.keep else []) + columns
    sql = f"SELECT {'DISTINCT ' if view.distinct else ''}{', '.join(items)} FROM "
    sql += view.source.format(**{n: ref(n) for n in view.needs})
    sql += f" WHERE {view.where}" if view.where else ""
    return sql + (f" GROUP BY {view.group}" if view.group else "")


def _closure(names: tuple[str, ...], known: dict[str, View] = VIEWS) -> list[str]:
    """Views behind ``names``, inputs first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in known or name in ordered:
            return
        for need in known[name].needs:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def ctes(*names: str) -> str:
    """Common table expressions defining ``names`` in standard quoting."""
    return ",\n".join(
        f"{n} AS ({select(n, chr(34), lambda t: t)})" for n in _closure(names)
    )


class SampleTables(Tables):
    """Base tables derived from the order tables in a folder of parquet files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._path = path.rstrip("/")
        self._read: dict[str, DataFrame] = {}
        super().__init__(lambda name: conform(self._view(f"fx_{name}"), name, trimmed=True))

    def _view(self, name: str, known: dict[str, View] = SPARK_VIEWS) -> DataFrame:
        views = _closure((name,), known)

        def ref(table: str) -> str:
            return table if table in known else f"{{{table}}}"

        sql = "WITH " + ", ".join(f"{n} AS ({select(n, '`', ref, known)})" for n in views)
        used = {n for v in views for n in known[v].needs if n not in known}
        frames = {n: self._base(n) for n in used}
        return self._spark.sql(f"{sql} SELECT * FROM {name}", **frames)

    def _base(self, name: str) -> DataFrame:
        if name not in self._read:  # each read looks into the files once
            self._read[name] = self._spark.read.parquet(f"{self._path}/{name}.parquet")
        return self._read[name]

    @cached_property
    def fielding(self) -> DataFrame:
        return conform(self._view("fx_fielding"), "fielding_c", keep={"pos": "pos"}, trimmed=True)

    def sharing(self, keep: Keep) -> SampleTables:
        """The same tables, with those of players' seasons from one stored pass over the plays."""
        return _SharingTables(self, keep)

    @cached_property
    def _season_sums(self) -> DataFrame:
        return self._view("fx_season_sums")


class _SharingTables(SampleTables):
    """Season tables that start from sums by player, season and position, stored by ``keep``."""

    def __init__(self, tables: SampleTables, keep: Keep) -> None:
        super().__init__(tables._spark, tables._path)
        self._read = dict(tables._read)
        self._keep = keep
        self._sums: DataFrame | None = None
        self._folded: dict[str, DataFrame] = {}

    def _season_table(self, name: str, declared: str, keep: dict[str, str] | None = None) -> DataFrame:
        sums = self._keep(self._season_sums)  # another frame once the store was cleared
        if sums is not self._sums:
            self._sums, self._folded = sums, {}
            self._read["fx_season_sums"] = sums
        if name not in self._folded:
            folded = self._view(f"fx_{name}", FROM_SUMS)
            self._folded[name] = conform(folded, declared, keep, trimmed=True)
        return self._folded[name]

    @property
    def batting(self) -> DataFrame:
        return self._season_table("batting", "batting")

    @property
    def pitching(self) -> DataFrame:
        return self._season_table("pitching", "pitching")

    @property
    def fielding(self) -> DataFrame:
        return self._season_table("fielding", "fielding_c", {"pos": "pos"})

"""Fielding value jobs as SQL: named steps, each statement using those it needs."""

from __future__ import annotations

from statline.sources.sample import ctes

POSITIONS = ("p", "c", "1b", "2b", "3b", "ss", "of")
TEAM = '"Year", "Lg", "Tm"'
BAT = ("AB", "R", "H", "2B", "3B", "HR", "BB", "SO", "HBP", "SH", "SF", "SB", "CS")
PIT = ("W", "L", "BF", "IP", "H", "R", "ER", "HR", "SH", "SF", "HBP", "BB", "SO", "WP", "BK",
       "IP_LHP", "SO_LHP")
FLD = ("PO", "A", "E", "DP", "PB")
LEAGUES = "('AA','AL','FL','NA','NL','PL','UA')"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(CAST({b} AS DOUBLE), 0))"


def f(column: str) -> str:
    """A column as a double."""
    alias, name = column.split(".")
    return f'CAST({alias}."{name}" AS DOUBLE)'


def fs(text: str) -> str:
    """Replace every ``alias.name`` of a formula by the column as a double."""
    import re

    return re.sub(
        r"\b([a-z]+)\.([A-Za-z0-9_]*[A-Za-z_][A-Za-z0-9_]*)", lambda m: f(m.group(0)), text
    )


STEPS: dict[str, tuple[str, tuple[str, ...]]] = {}


def step(name: str, sql: str, *needs: str) -> None:
    STEPS[name] = (sql, needs)


def statement(name: str) -> str:
    """The step as a whole statement, with all it builds on."""
    order: list[str] = []
    views: list[str] = []

    def visit(n: str) -> None:
        if n.startswith("fx_"):
            if n not in views:
                views.append(n)
        elif n not in order:
            for need in STEPS[n][1]:
                visit(need)
            order.append(n)

    visit(name)
    steps = "".join(f",\n{n} AS ({STEPS[n][0]})" for n in order)
    return f"WITH {ctes(*views)}{steps}\nSELECT * FROM {name}"


def total(column: str, alias: str | None = None) -> str:
    return f'CAST(sum("{column.lower()}") AS BIGINT) AS "{alias or column}"'


# --- team totals --------------------------------------------------------------

step(
    "w1",
    f'SELECT year AS "Year", lg AS "Lg", tm AS "Tm", {", ".join(map(total, BAT))} '
    "FROM fx_batting WHERE tm <> 'TOT' GROUP BY ALL",
    "fx_batting",
)
IP = """CASE right(CAST(ip AS VARCHAR), 3) WHEN '.10' THEN ip + 0.23 WHEN '.20' THEN ip + 0.47
 ELSE CAST(ip AS DECIMAL(18,2)) END"""
step(
    "innings",
    f"SELECT *, {IP} AS real_ip, name LIKE '%*' AS left_handed FROM "
    "(SELECT * REPLACE (CAST(ip AS DECIMAL(16,2)) AS ip) FROM fx_pitching)",
    "fx_pitching",
)
step(
    "w2b",
    f'SELECT year AS "Year", lg AS "Lg", tm AS "Tm", CAST(sum(real_ip) AS DOUBLE) AS "IP" '
    "FROM innings WHERE tm <> 'TOT' GROUP BY ALL",
    "innings",
)
step(
    "w2c",
    'SELECT year AS "Year", lg AS "Lg", tm AS "Tm", '
    'CAST(coalesce(sum(real_ip) FILTER (WHERE left_handed), 0) AS DOUBLE) AS "IP_LHP", '
    'CAST(coalesce(sum(so) FILTER (WHERE left_handed), 0) AS BIGINT) AS "SO_LHP" '
    "FROM innings WHERE tm <> 'TOT' GROUP BY ALL",
    "innings",
)


def own_side(own: str, opp: str) -> str:
    """One side of every game under the season tables' team code."""
    return (
        f'SELECT t.yearid AS "Year", t.lgid AS "Lg", t.teamidbr AS "Tm", \'{own}\' AS side, '
        f"greatest(coalesce(g.{opp}sh, 0), 0) AS sh, greatest(coalesce(g.{opp}sf, 0), 0) AS sf, "
        f"greatest(coalesce(g.{own}dp, 0), 0) AS dp, g.homleague AS host, "
        "(g.homscore > g.visscore) AS home_won "
        "FROM fx_gamelogs g JOIN fx_teams t ON CAST(left(g.yyyymmdd, 4) AS INT) = t.yearid "
        f"AND g.{own}league = t.lgid AND g.{own}team = t.teamidretro"
    )


step(
    "sides",
    f"{own_side('hom', 'vis')} UNION ALL {own_side('vis', 'hom')}",
    "fx_gamelogs",
    "fx_teams",
)
step(
    "w2a",
    f'SELECT {TEAM}, CAST(sum(sh) AS BIGINT) AS "SH", CAST(sum(sf) AS BIGINT) AS "SF" '
    "FROM sides GROUP BY ALL",
    "sides",
)
step(
    "w2",
    f"""SELECT {", ".join(f'p."{k}"' for k in ("Year", "Lg", "Tm"))},
 "W", "L", {div('CAST("W" AS DOUBLE)', '"W" + "L"')} AS "WPCT",
 "BF", b."IP", "H", "R", "ER", "HR", s."SH", s."SF", "HBP", "BB", "SO", "WP", "BK",
 c."IP_LHP", c."SO_LHP"
 FROM (SELECT year AS "Year", lg AS "Lg", tm AS "Tm", {", ".join(total(c) for c in
       ("W", "L", "BF", "H", "R", "ER", "HR", "BB", "SO", "WP", "BK"))},
       CAST(sum(coalesce(hbp, 0)) AS BIGINT) AS "HBP" FROM fx_pitching GROUP BY ALL) p
 JOIN w2a s USING ({TEAM}) JOIN w2b b USING ({TEAM}) JOIN w2c c USING ({TEAM})""",
    "fx_pitching",
    "w2a",
    "w2b",
    "w2c",
)
step(
    "w3a",
    f'SELECT {TEAM}, CAST(sum(dp) AS BIGINT) AS "DP" FROM sides GROUP BY {TEAM} '
    "HAVING count(DISTINCT side) = 2",
    "sides",
)
for _pos in POSITIONS:
    _stats = ["Inn", "PO", "A", "E", "DP"] + (["PB", "SB", "CS"] if _pos == "c" else [])
    step(
        f"team_{_pos}",
        f'SELECT year AS "Year", lg AS "Lg", tm AS "Tm", {", ".join(map(total, _stats))} '
        f"FROM fx_fielding_{_pos} WHERE tm <> 'TOT' GROUP BY ALL",
        f"fx_fielding_{_pos}",
    )
    step(
        f"league_{_pos}",
        f'SELECT "Year", "Lg", {", ".join(total(s) for s in _stats)} '
        f"FROM team_{_pos} WHERE \"Lg\" <> 'MLB' GROUP BY ALL",
        f"team_{_pos}",
    )
_ALL = " ".join(f'JOIN team_{p} t{p} USING ({TEAM})' for p in POSITIONS[1:])
step(
    "w3",
    f"SELECT {TEAM}, "
    + ", ".join(" + ".join(f't{p}."{s}"' for p in POSITIONS) + f' AS "{s}"' for s in FLD[:3])
    + f', tc."PB" AS "PB", d."DP" AS "DP" FROM team_p tp {_ALL} JOIN w3a d USING ({TEAM})',
    *[f"team_{p}" for p in POSITIONS],
    "w3a",
)
step(
    "w4",
    f'SELECT {TEAM}, "W_HOME", "L_ROAD" FROM '
    '(SELECT "Year", "Lg", "Tm", count(*) FILTER (WHERE home_won) AS "W_HOME" '
    "FROM sides WHERE side = 'hom' GROUP BY ALL) JOIN "
    '(SELECT "Year", host AS "Lg", "Tm", count(*) FILTER (WHERE home_won) AS "L_ROAD" '
    f"FROM sides WHERE side = 'vis' GROUP BY ALL) USING ({TEAM})",
    "sides",
)

# --- parks --------------------------------------------------------------------

CLUB = '"YearID", "Lg", "Tm"'
HOME_ROAD = tuple(f"{s}_{w}" for w in ("home", "road") for s in ("games", "runs", "hr"))


def _sums(side: str) -> str:
    return (
        f'SELECT CAST(left(yyyymmdd, 4) AS INT) AS "YearID", {side}league AS "Lg", '
        f'{side}team AS "Tm", count(*) AS games, '
        "CAST(sum(homscore) + sum(visscore) AS BIGINT) AS runs, "
        "CAST(sum(homhr) + sum(vishr) AS BIGINT) AS hr "
        "FROM fx_gamelogs GROUP BY ALL"
    )


step(
    "w6b",
    f"SELECT {CLUB}, h.games AS games_home, coalesce(h.runs, 0) AS runs_home, "
    "coalesce(h.hr, 0) AS hr_home, coalesce(r.games, 0) AS games_road, "
    "coalesce(r.runs, 0) AS runs_road, coalesce(r.hr, 0) AS hr_road "
    f"FROM ({_sums('hom')}) h LEFT JOIN ({_sums('vis')}) r USING ({CLUB})",
    "fx_gamelogs",
)
step(
    "w5",
    f"SELECT {CLUB}, CAST(sum(games) AS BIGINT) AS games_home, "
    "CAST(sum(coalesce(runs, 0)) AS BIGINT) AS runs_home, "
    "CAST(sum(coalesce(hr, 0)) AS BIGINT) AS hr_home, "
    "any_value(games_road) AS games_road, any_value(runs_road) AS runs_road, "
    "any_value(hr_road) AS hr_road FROM "
    f"({_sums('hom').replace('count(*)', 'parkid, count(*)', 1)}) JOIN w6b USING ({CLUB}) "
    "GROUP BY ALL",
    "fx_gamelogs",
    "w6b",
)
_DIMS = ("lf_dim", "cf_dim", "rf_dim", "lf_w", "cf_w", "rf_w")
step(
    "w6a",
    "SELECT b.year AS year_base, b.parkid, b.retrotm, b.lg, e.year AS years_ext "
    "FROM fx_parkconfig b LEFT JOIN fx_parkconfig e ON b.parkid = e.parkid "
    "AND b.year <> e.year AND abs(b.year - e.year) <= 2 "
    + " ".join(f"AND b.{d} = e.{d}" for d in _DIMS),
    "fx_parkconfig",
)
step(
    "w6n",
    'SELECT years_ext AS "YearID", retrotm AS "Tm", count(*) AS n FROM w6a '
    "WHERE years_ext IS NOT NULL GROUP BY ALL",
    "w6a",
)
step(
    "w6c",
    "SELECT s.*, "
    + ", ".join(
        f'(SELECT CAST(sum(o.{c}) AS BIGINT) FROM w6b o WHERE o."Tm" = s."Tm" '
        f'AND abs(o."YearID" - s."YearID") IN (1, 2)) AS near_{c}'
        for c in HOME_ROAD
    )
    + " FROM w6b s",
    "w6b",
)


def _factor(stat: str) -> str:
    def rate(side: str, kind: str) -> str:
        v, g = f"CAST({stat}_{side} AS DOUBLE)", f"CAST(games_{side} AS DOUBLE)"
        if kind == "padded":
            return div(f"{v} + 100", f"{g} + 10")
        if kind == "own":
            return div(v, g)
        return div(f"k * {v} + near_{stat}_{side}", f"k * {g} + near_games_{side}")

    def over(kind: str) -> str:
        return div(rate("home", kind), rate("road", kind))

    return (
        f'CASE WHEN "YearID" < 1909 THEN {over("padded")} '
        f"WHEN k = 0 THEN {over('own')} ELSE {over('near')} END"
    )


step(
    "w6",
    f"SELECT {CLUB}, games_home, {_factor('runs')} AS park_run_factor, "
    f"{_factor('hr')} AS park_hr_factor FROM "
    '(SELECT w6c.*, CAST(coalesce(n, 0) AS DOUBLE) AS k FROM w6c LEFT JOIN w6n '
    'USING ("YearID", "Tm"))',
    "w6c",
    "w6n",
)

# --- leagues ------------------------------------------------------------------


def _league_sum(alias: str, names: tuple[str, ...], sfx: str) -> list[str]:
    kind = {"IP": "DOUBLE", "IP_LHP": "DOUBLE"}
    exact = {"IP", "IP_LHP"}
    return [
        f"CAST(sum({f'CAST({alias}."{n}" AS DECIMAL(18,2))' if n in exact else f'{alias}."{n}"'}) "
        f'AS {kind.get(n, "BIGINT")}) AS "{n}{sfx}"'
        for n in names
    ]


_gone = 'p."BB" - p."SO" - p."HBP"'
step(
    "w7",
    'SELECT "Year", "Lg", '
    + ", ".join(
        _league_sum("b", BAT, "_b")
        + _league_sum("p", PIT, "_p")
        + _league_sum("m", ("W_HOME", "L_ROAD"), "")
        + _league_sum("f", FLD, "")
    )
    + f', {div("CAST(sum(b.\"R\") AS DOUBLE)", "sum(b.\"AB\" - b.\"H\" + b.\"CS\")")} '
    'AS "RUNS_PER_OUT_LG", '
    + div(
        f'CAST(sum(p."BF" - p."H" - {_gone}) AS DOUBLE)', f'sum(p."BF" - p."HR" - {_gone})'
    )
    + f' AS "DER_LG" FROM w1 b JOIN w2 p USING ({TEAM}) JOIN w4 m USING ({TEAM}) '
    f"JOIN w3 f USING ({TEAM}) GROUP BY 1, 2",
    "w1", "w2", "w3", "w4",
)


def _positional(grain: str, keys: str, tag: str, so: str) -> None:
    columns = []
    for p in POSITIONS:
        stats = ["Inn", "PO", "A", "E", "DP"] + (["PB", "SB", "CS"] if p == "c" else [])
        columns += [f'x{p}."{s}" AS "{s.upper()}_{p.upper()}_{tag}"' for s in stats]
        chances = f'CAST(x{p}."PO" AS DOUBLE) + x{p}."A"'
        if p == "c":
            made = f"{chances} - k.so"
            rate = f"1 - {div(made, f'{made} + xc."E"')}"
        else:
            rate = div(f'CAST(x{p}."E" AS DOUBLE)', f'{chances} + x{p}."E"')
        if p != "p":
            columns.append(f'{rate} AS "EPct_{p.upper()}_{tag}"')
    joins = " ".join(f"JOIN {grain}_{p} x{p} USING ({keys})" for p in POSITIONS[1:])
    source = ", ".join(f'{k.lower()} AS {k}' for k in keys.replace(",", "").split())
    step(
        f"{grain}_fielding",
        f'SELECT {keys}, {", ".join(columns)}, k.so AS "{so}" FROM {grain}_p xp {joins} '
        f"JOIN (SELECT {source}, CAST(sum(so) AS BIGINT) AS so FROM fx_pitching GROUP BY ALL) k "
        f"USING ({keys}) WHERE \"Lg\" <> 'MLB'",
        *[f"{grain}_{p}" for p in POSITIONS],
        "fx_pitching",
    )


def _source_names(sql: str) -> str:
    return sql.replace('"year" AS', "year AS").replace('"lg" AS', "lg AS").replace(
        '"tm" AS', "tm AS"
    )


_positional("league", '"Year", "Lg"', "LG", "SO_p")
_positional("team", TEAM, "TM", "SO_P_TM")
STEPS["league_fielding"] = (_source_names(STEPS["league_fielding"][0]), STEPS["league_fielding"][1])
STEPS["team_fielding"] = (_source_names(STEPS["team_fielding"][0]), STEPS["team_fielding"][1])

_est_a = (
    "{g}.PO_1B_{t} - 0.7e0*{g}.A_P_{t} - 0.86e0*{g}.A_2B_{t} "
    "- 0.78e0*({g}.A_3B_{t} + {g}.A_SS_{t}) + 0.115e0*({rob}) - 0.0575e0*({play})"
)
_throws = "{g}.A_1B_{t} + 0.5e0*{g}.DP_SS_{t} - {g}.PO_P_{t} + 0.5e0*{g}.DP_2B_{t}"
_rob_lg = "l.H_b - l.2B_b - l.3B_b - l.HR_b + l.BB_p + l.HBP_p - g.PB_C_LG - l.WP_p - l.BK_p"
_play_lg = "3*l.IP_p - l.SO_p"
step(
    "w9",
    'SELECT "Year", "Lg", "X_Lg", "ROB_Lg", "EstA_Lg", "EstB_Lg", '
    '(2*"EstA_Lg" + "EstB_Lg") / 3 AS "EstC_Lg", "FA_Lg", "SHR_Lg" FROM (SELECT "Year", "Lg", '
    + fs(
        f"{div(_throws.format(g='g', t='LG'), 'k.clubs')} AS \"X_Lg\", "
        f'{_rob_lg} AS "ROB_Lg", '
        f"{_est_a.format(g='g', t='LG', rob=_rob_lg, play=_play_lg)} AS \"EstA_Lg\", "
        f'({_play_lg})*0.1e0 - g.A_1B_LG AS "EstB_Lg", 1 - g.EPct_3B_LG AS "FA_Lg", '
        f"{div('l.SH_p', 'l.W_p + 2*l.L_p')} AS \"SHR_Lg\""
    )
    + ' FROM league_fielding g JOIN w7 l USING ("Year", "Lg") JOIN '
    '(SELECT year AS "Year", lg AS "Lg", count(DISTINCT tm) AS clubs FROM fx_pitching '
    "WHERE tm <> 'TOT' GROUP BY ALL) k USING (\"Year\", \"Lg\"))",
    "league_fielding", "w7", "fx_pitching",
)

# --- stages -------------------------------------------------------------------

_single = "(l.H_b - l.2B_b - l.3B_b - l.HR_b)"
_h = div("l.HR_b*1.5e0", "l.R_b")
_lgr = div("l.R_p", "l.IP_p")
_derq = div("p.BF - p.H - (p.BB + p.SO + p.HBP)", "p.BF - p.HR - (p.BB + p.SO + p.HBP)")
_rad = div(f"q.prf - q.phf*{_h}", f"1 - {_h}")
_phf = "CASE WHEN q.phf = 0 THEN 1e0 ELSE coalesce(q.phf, 1e0) END"
_lgip = "CASE WHEN l.IP_p = 0 THEN 1e0 ELSE l.IP_p END"
_edp = (
    f"({div(_single, 'l.H_b - l.HR_b')}*(p.H - p.HR) + p.BB + p.HBP - p.SH - p.WP - p.BK)"
    f" * {div('l.DP', f'{_single} + l.BB_p + l.HR_p - l.SH_p - l.WP_p - l.BK_p - l.PB')}"
    f" * {div(div('f.A', 'p.IP'), div('l.A', 'l.IP_p'))}"
)
_lh = (
    f"3*p.IP_LHP - p.SO_LHP - {div('3*l.IP_LHP_p - l.SO_LHP_p', '3*l.IP_p - l.SO_p')}"
    "*(3*p.IP - p.SO)"
)
_parts = {
    "derq": _derq,
    "ps": f"CASE WHEN {_rad} >= 0 THEN sqrt({_rad}) END",
    "mr": f"b.R - {_lgr}*q.prf*0.52e0*(p.IP - m.W_HOME + m.L_ROAD)",
    "mra": f"{_lgr}*q.prf*1.52e0*p.IP - p.R",
    "cl2": f"28.571e0*({div('p.SO*9', 'p.IP')} + 2.5e0)",
    "cl3": f"{div('l.HBP_p + l.BB_p', 'l.IP_p')}*p.IP - p.BB - p.HBP + 200",
    "cl4": f"5*({div('l.HR_p', _lgip)}*p.IP - {div('p.HR', _phf)}) + 200",
    "cl5": f"100 + {div('l.E + 0.5e0*l.PB', 'l.IP_p')}*p.IP - 0.5e0*f.PB - f.E",
    "edp2": _edp,
    "o0": f"{div('l.R_b', 'l.AB_b - l.H_b + l.CS_b')}*0.52e0*q.prf",
    "x0": f"{div('l.R_p*9', 'l.IP_p')}*q.prf*1.52e0",
    "era9": div("p.ER*9", "p.IP"),
    "tlpop": div("f.PO - p.SO", "l.PO - l.SO_p"),
    "lh": _lh,
    "w3x": "3*p.W",
    "won": "405*p.WPCT",
    "derlg": "l.DER_LG",
    "dpf": "f.DP",
}
step(
    "parks",
    'SELECT w6."YearID" AS "Year", w6."Lg", t.teamidbr AS "Tm", park_run_factor AS prf, '
    'park_hr_factor AS phf FROM w6 JOIN fx_teams t ON t.yearid = w6."YearID" '
    'AND t.lgid = w6."Lg" AND t.teamidretro = w6."Tm"',
    "w6",
    "fx_teams",
)
step(
    "claims",
    f"SELECT {TEAM}, "
    + ", ".join(f"{fs(v)} AS {k}" for k, v in _parts.items())
    + f" FROM w1 b JOIN w2 p USING ({TEAM}) JOIN w4 m USING ({TEAM}) JOIN w3 f USING ({TEAM}) "
    f'JOIN parks q USING ({TEAM}) JOIN w7 l USING ("Year", "Lg")',
    "w1", "w2", "w3", "w4", "w7", "parks",
)
step(
    "shares",
    f"SELECT *, {div('cl1 + cl2 + cl3 + cl4 + won + 650', '2*cl1 + cl2 + cl3 + cl4 + cl5 + cl6 + 1097.5e0 + won')} AS raw, "
    f"{div('mr', 'mr + mra')}*w3x AS ow0 FROM (SELECT *, 100 + 2500*(der - derlg) AS cl1, "
    f"100 + (dpf - edp2)*4/3 AS cl6 FROM (SELECT *, 1 - {div('1 - derq', 'ps')} AS der "
    "FROM claims))",
    "claims",
)
step(
    "w11",
    'SELECT "Year" AS "YearID", "Lg", "Tm", der AS "DER", ps AS "P-S", mr AS "MR", mra AS "MRA", '
    'CASE WHEN raw < 0.16375e0 THEN 0.16375e0 WHEN raw > 0.32375e0 THEN 0.32375e0 ELSE raw END '
    'AS "P_Pct", ow AS "OW", w3x - ow AS "DW", (w3x - ow)*raw AS "PW", '
    '(w3x - ow) - (w3x - ow)*raw AS "FW", cl1 AS "CL-1", cl2 AS "CL-2", cl3 AS "CL-3", '
    'cl4 AS "CL-4", cl5 AS "CL-5", cl6 AS "CL-6", edp2 AS "EDP2", o0 AS "O-0", '
    'x0 - (x0 - era9)*(1 - raw) AS "P-0", tlpop AS "TLPOP", lh AS "LH" '
    f"FROM (SELECT *, {div('mr', 'mr + mra')}*3*(w3x/3) AS ow FROM shares)",
    "shares",
)
_JOIN2 = (
    f"FROM w1 b JOIN w2 p USING ({TEAM}) JOIN team_fielding t USING ({TEAM}) "
    f"JOIN w3 f USING ({TEAM}) JOIN w7 l USING (\"Year\", \"Lg\") "
    'JOIN league_fielding g USING ("Year", "Lg") JOIN w9 y USING ("Year", "Lg") '
    'JOIN w11 s ON s."YearID" = b."Year" AND s."Lg" = b."Lg" AND s."Tm" = b."Tm"'
)
_rob = f"{div(f'(p.H - p.HR)*{_single}', 'l.H_b - l.HR_b')} + p.BB + p.HBP - p.WP - f.PB - p.BK"
_walks = f"(p.BB - {div('l.BB_p', 'l.IP_p')}*p.IP)"


def _epo(pos: str, walks: int, left: int) -> str:
    share = div(f"(f.PO - p.SO)*g.PO_{pos}_LG", "l.PO - l.SO_p")
    return f"{share} + {_walks}/{walks} + s.LH/{left}"


_second = {
    "ROB": _rob,
    "EstA": _est_a.format(g="t", t="TM", rob=_rob, play="3*p.IP - p.SO"),
    "EstB": "(3*p.IP - p.SO)*0.1e0 - t.A_1B_TM",
    "X": _throws.format(g="t", t="TM") + " + 0.015e0*s.LH",
    "EPO_2B": _epo("2B", 13, 32),
    "EPO_SS": _epo("SS", 14, 64),
    "EE": f"{div('t.PO_3B_TM + t.PO_SS_TM', 'y.FA_Lg')} - t.PO_3B_TM - t.PO_SS_TM",
    "SHR": div("p.SH", "p.W + 2*p.L"),
    "EA": f"{div('f.A*g.A_3B_LG', 'l.A')} + s.LH/31",
}
step(
    "w12",
    'SELECT *, (2*"EstA" + "EstB")/3 AS "EstC" FROM (SELECT b."Year", b."Lg", b."Tm", '
    + ", ".join(f'{fs(v)} AS "{k}"' for k, v in _second.items())
    + f" {_JOIN2})",
    "w1", "w2", "w3", "w7", "w9", "w11", "team_fielding", "league_fielding",
)


def _one(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 1e0 ELSE {x} END"


def _errors(pos: str, base: int, scale: int) -> str:
    return f"{base} - {div(f'{scale}*t.EPct_{pos}_TM', f'g.EPct_{pos}_LG')}"


_cs = {
    tag: div(f"{a}.CS_C_{tag}", f"{_one(f'{a}.SB_C_{tag}')} + {a}.CS_C_{tag}")
    for tag, a in (("TM", "t"), ("LG", "g"))
}
_third = {
    "C": (
        f"25 + ({_cs['TM']} - {_cs['LG']})*150",
        _errors("C", 30, 15),
        "5 + (t.PB_C_TM - g.PB_C_LG*s.TLPOP)/5",
        f"10 - {div('p.SF', f'({_one("l.SF_p")})*l.HR_p')}*5",
    ),
    "1B": (
        "20 + (z.EstC + t.A_1B_TM + 0.0285e0*s.LH - (y.EstC_Lg + g.A_1B_LG)*s.TLPOP)/5",
        _errors("1B", 30, 15),
        "10 + (z.X - y.X_Lg)/5",
        f"10 - 5*{div('t.E_3B_TM + t.E_SS_TM', '(g.E_3B_LG + g.E_SS_LG)*s.TLPOP')}",
    ),
    "2B": (
        "20 + (f.DP - s.EDP2)/3",
        "(t.A_2B_TM - t.DP_2B_TM - ((g.A_2B_LG - g.DP_2B_LG)*s.TLPOP - s.LH/35))/6 + 15",
        _errors("2B", 24, 14),
        "(t.PO_2B_TM - z.EPO_2B)/12 + 5",
    ),
    "3B": (
        "(t.A_3B_TM - z.EA)/4 + 25",
        "(z.EE - t.E_3B_TM)/2 + 15",
        f"10 - {div('z.SHR', _one('y.SHR_Lg'))}*5",
        f"(t.DP_3B_TM - {div('s.EDP2*g.DP_3B_LG', _one('l.DP'))})/2 + 5",
    ),
    "SS": (
        f"(t.A_SS_TM - (f.A*{div('g.A_SS_LG', 'l.A')} + s.LH/100))/4 + 20",
        "(f.DP - s.EDP2)/4 + 15",
        _errors("SS", 20, 10),
        "(t.PO_SS_TM - z.EPO_SS)/5 + 5",
    ),
    "OF": (
        f"({div('t.PO_OF_TM', 'f.PO - f.A - p.SO')} "
        f"- {div('g.PO_OF_LG', 'l.PO - l.A - l.SO_p')})*100 + 20",
        's."CL-1"*0.24e0 + (-9)',
        "((t.A_OF_TM + t.DP_OF_TM - p.SF) - (g.A_OF_LG + g.DP_OF_LG - l.SF_p)*s.TLPOP)/5 + 10",
        _errors("OF", 10, 5),
    ),
}
step(
    "w13",
    'SELECT b."Year", b."Lg", b."Tm", '
    + ", ".join(
        f'{fs("(" + " + ".join(f"({p})" for p in parts) + ")/100e0")} AS "c{pos}_Pct"'
        for pos, parts in _third.items()
    )
    + f' {_JOIN2} JOIN w12 z ON z."Year" = b."Year" AND z."Lg" = b."Lg" AND z."Tm" = b."Tm"',
    "w1", "w2", "w3", "w7", "w9", "w11", "w12", "team_fielding", "league_fielding",
)
_WEIGHTS = {"c": 38, "1b": 12, "2b": 32, "3b": 24, "ss": 36, "of": 58}
step(
    "w14",
    f"SELECT {TEAM}, "
    + ", ".join(f'fcr*"t_{p}" AS "{p}FW"' for p in _WEIGHTS)
    + f" FROM (SELECT *, {div('"FW"', ' + '.join(f'"t_{p}"' for p in _WEIGHTS))} AS fcr FROM "
    '(SELECT w13."Year", w13."Lg", w13."Tm", "FW", '
    + ", ".join(f'("c{p.upper()}_Pct" - 0.2e0)*{w} AS "t_{p}"' for p, w in _WEIGHTS.items())
    + ' FROM w13 JOIN w11 s ON s."YearID" = w13."Year" AND s."Lg" = w13."Lg" '
    'AND s."Tm" = w13."Tm"))',
    "w11",
    "w13",
)

# --- players ------------------------------------------------------------------

_NULLS = 'CAST(NULL AS BIGINT) AS "PB", CAST(NULL AS BIGINT) AS "SB", CAST(NULL AS BIGINT) AS "CS"'


def _players(pos: str) -> str:
    plain = f"d.po + {4 if pos == 'of' else 2}*d.a - 5*d.e"
    join, extra = "", _NULLS
    if pos == "c":
        value = "d.po + 2*(d.a - d.cs) - 8*d.e + 6*d.dp - 4*d.pb - 2*d.sb + 4*d.cs"
        extra = 'd.pb AS "PB", d.sb AS "SB", d.cs AS "CS"'
        join = 'JOIN w2 k ON k."Year" = d.year AND k."Lg" = d.lg AND k."Tm" = d.tm'
    elif pos == "1b":
        value = plain
    else:
        tag = pos.upper()
        ip = "3*k.ip" if pos == "of" else "k.ip"
        rate = div(f"k.chances_{pos}", ip)
        bonus = f"greatest(({div('CAST(d.po + d.a AS DOUBLE)', 'd.inn')} - {rate})*d.inn, 0)"
        value = f"{plain}{'' if pos == 'of' else ' + d.dp'} + 2*coalesce({bonus}, 0)"
        join = (
            f'JOIN (SELECT {TEAM}, "IP" AS ip, CAST(t."PO_{tag}_TM" + t."A_{tag}_TM" AS DOUBLE) '
            f"AS chances_{pos} FROM team_fielding t JOIN w2 USING ({TEAM})) k "
            'ON k."Year" = d.year AND k."Lg" = d.lg AND k."Tm" = d.tm'
        )
    points = f"CASE WHEN d.inn > 0 AND {value} > 0 THEN CAST({value} AS DOUBLE) ELSE 0 END"
    return (
        f'SELECT d.year AS "Year", d.lg AS "Lg", d.tm AS "Tm", \'{pos}\' AS "Pos", '
        'd.name AS "Name", d."name-additional" AS "BBRefID", CAST(d.inn AS BIGINT) AS "Inn", '
        'd.po AS "PO", d.a AS "A", d.e AS "E", d.dp AS "DP", '
        f'{extra}, floor(({points})*1e6 + 0.5e0)/1e6 AS "ClaimPoints" '
        f"FROM fx_fielding_{pos} d {join} WHERE d.lg IN {LEAGUES} AND d.year >= 1901"
    )


step(
    "w15",
    "SELECT * REPLACE ("
    + ", ".join(
        f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ("PO", "A", "E", "DP", "PB", "SB", "CS")
    )
    + ") FROM ("
    + " UNION ALL ".join(_players(p) for p in POSITIONS[1:])
    + ")",
    *[f"fx_fielding_{p}" for p in POSITIONS[1:]],
    "w2",
    "team_fielding",
)
step(
    "w16",
    'SELECT "Year", "Lg", "Tm", "Name", "Pos", "BBRefID", "Inn", '
    f'{div("CAST(\"Inn\" AS DOUBLE)*162", "gs")} AS "Inn_adj", fws AS "FWS", '
    f'{div("fws*162", "gs")} AS "FWSadj", '
    f'{div("fws", "CASE WHEN \"Inn\" > 0 THEN \"Inn\" ELSE 1 END")}*1458 AS "FWS/1458" FROM '
    f'(SELECT w15.*, k.gs, {div("\"ClaimPoints\"", "pool")} * CASE "Pos" '
    + " ".join(f"WHEN '{p}' THEN \"{p}FW\"" for p in _WEIGHTS)
    + f" END AS fws FROM w15 JOIN w14 USING ({TEAM}) JOIN "
    '(SELECT "Year", "Lg", "Tm", "Pos", CAST(CAST(sum(CAST(round("ClaimPoints"*1e6) AS BIGINT)) '
    'AS BIGINT) AS DOUBLE)/1e6 AS pool FROM w15 GROUP BY ALL) USING ("Year", "Lg", "Tm", "Pos") '
    'JOIN (SELECT year AS "Year", lg AS "Lg", tm AS "Tm", CAST(sum(gs) AS DOUBLE) AS gs '
    f"FROM fx_pitching WHERE tm <> 'TOT' GROUP BY ALL) k USING ({TEAM}))",
    "w14",
    "w15",
    "fx_pitching",
)
step(
    "w16_one",
    'SELECT * FROM w16 WHERE "Year" = 1997 AND "BBRefID" = \'b07x3\'',
    "w16",
)

KEYS = {
    "w1_team_batting": "w1",
    "w2_team_pitching": "w2",
    "w2a_opponent_sacrifices": "w2a",
    "w2b_team_innings": "w2b",
    "w2c_left_hander_split": "w2c",
    "w3_team_fielding": "w3",
    "w3a_team_double_plays": "w3a",
    "w4_home_wins_road_losses": "w4",
    "w5_park_stats": "w5",
    "w6_park_factors": "w6",
    "w6a_comparable_park_years": "w6a",
    "w6a_comparable_counts": "w6n",
    "w6b_home_road_stats": "w6b",
    "w6c_neighbour_season_sums": "w6c",
    "w7_league_totals": "w7",
    "w8_league_position_fielding": "league_fielding",
    "w9_league_factors": "w9",
    "w10_team_position_fielding": "team_fielding",
    "w11_stage1": "w11",
    "w12_stage2": "w12",
    "w13_stage3": "w13",
    "w14_positional_team_shares": "w14",
    "w15_claim_points": "w15",
    "w16_fielding_win_shares": "w16",
    "w16_fielding_win_shares_one_player": "w16_one",
}


def statements() -> dict[str, str]:
    return {key: statement(name) for key, name in KEYS.items()}

"""Rating-card jobs as SQL."""

from __future__ import annotations

from statline.sources.sample import ctes


def slots(pos: str) -> str:
    pairs = ", ".join(f"{{'p': pos{i}, 'r': rg{i}}}" for i in range(1, 9))
    return (
        "SELECT lastname, firstname, retroid, age, TRY_CAST(slot.r AS DOUBLE) AS rg FROM "
        "(SELECT lastname, firstname, retroid, age, "
        f"unnest([{pairs}]) AS slot FROM fx_allbatters WHERE year >= 1997) "
        f"WHERE slot.p = '{pos}'"
    )


def by_age(pos: str) -> str:
    ages = ", ".join(f'min(rg) FILTER (WHERE age = {a}) AS "{a}"' for a in range(16, 51))
    return (
        f"SELECT lastname, firstname, retroid, {ages} FROM ({slots(pos)}) "
        "GROUP BY lastname, firstname, retroid"
    )


def statements() -> dict[str, str]:
    cards = f"WITH {ctes('fx_allbatters')}\n"
    return {
        "s1_position_slots": cards + slots("C"),
        "s2_pivot_by_age": cards + by_age("C"),
        "s3_range_by_age": cards + by_age("C") + " ORDER BY retroid",
        "s3_range_by_age_shortstops": cards + by_age("SS") + " ORDER BY retroid",
    }

from build import CARD, by, table

from statline import range_by_age
from statline.operators.ratings import position_slots


def cards(spark, *rows):
    return table(spark, "allbatters", list(rows), CARD)


def test_slots_before_the_five_point_scale_are_dropped(spark):
    df = cards(
        spark,
        {"pos1": "C", "rg1": "3", "year": 1996},
        {"pos1": "C", "rg1": "2", "year": 1997},
    )
    assert [r.rg for r in position_slots(df, "C").collect()] == [2.0]


def test_position_named_twice_gives_two_rows(spark):
    df = cards(spark, {"pos1": "C", "rg1": "3", "pos8": "C", "rg8": "1", "pos2": "SS", "rg2": "5"})
    assert sorted(r.rg for r in position_slots(df, "C").collect()) == [1.0, 3.0]
    assert by(range_by_age(df, "C"), "retroid")["x"]["25"] == 1.0


def test_blank_rating_in_another_slot_is_never_read(spark):
    df = cards(spark, {"pos1": "C", "rg1": "3", "pos2": "SS", "rg2": ""})
    assert [r.rg for r in position_slots(df, "C").collect()] == [3.0]


def test_ages_out_of_range_leave_an_empty_row(spark):
    df = cards(spark, {"pos1": "C", "rg1": "3", "age": 55}, {"pos1": "C", "rg1": "2", "retroid": "a"})
    rows = range_by_age(df, "C").collect()
    assert [r.retroid for r in rows] == ["a", "x"]
    assert all(rows[1][str(age)] is None for age in range(16, 51))
    assert range_by_age(df, "C").columns[3:] == [str(a) for a in range(16, 51)]

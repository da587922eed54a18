"""SQL text helpers for long formulas.

The value formulas run to hundreds of terms. As text they read like the
formulas they are, and reach Catalyst in one call each instead of one call per
operator.
"""

from __future__ import annotations


def num(value: float) -> str:
    """A number as a double literal (a bare 0.7 would be a decimal)."""
    return f"{value}D"


def ratio(numerator: str, denominator: str) -> str:
    """Division of doubles, NULL instead of an error for a zero divisor."""
    return f"try_divide({numerator}, {denominator})"


def nonzero(value: str) -> str:
    """The value, or one in place of zero. NULL stays NULL."""
    return f"CASE WHEN {value} = 0 THEN 1D ELSE {value} END"


def guarded_sqrt(value: str) -> str:
    """Square root, NULL (not NaN) below zero."""
    return f"CASE WHEN {value} >= 0 THEN sqrt({value}) END"


def rounded(value: str, places: int) -> str:
    """Round half up by floor, the same in any IEEE engine."""
    unit = num(float(10**places))
    return f"floor(({value}) * {unit} + 0.5D) / {unit}"


def half_up_ratio(numerator: str, denominator: str, precision: int, scale: int) -> str:
    """A ratio of whole numbers as ``decimal(precision, scale)``, half up.

    Works on integers only, so no binary fraction can tip a tie. NULL unless
    the denominator is positive.
    """
    units = f"({2 * 10**scale}L * ({numerator}) + ({denominator})) div (2L * ({denominator}))"
    return f"CASE WHEN ({denominator}) > 0 THEN {fixed_point(units, precision, scale)} END"


def fixed_point(units: str, precision: int, scale: int) -> str:
    """Whole units of 10^-scale as ``decimal(precision, scale)``."""
    step = "1" if scale == 0 else f"0.{'0' * (scale - 1)}1"
    return f"cast(cast({units} AS decimal(18,0)) * {step} AS decimal({precision},{scale}))"

"""Sizes, steps and tolerances of figures, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from numerant.lexicon import CURRENCIES, PERCENT_UNITS

#: Sizes after scaling: 32 digits before and 6 after the point.
SIZE = "decimal(38,6)"


def literal_map(table: dict) -> Column:
    """A map of constants, of text or whole numbers, as one expression."""
    told = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(told(x) for pair in table.items() for x in pair) + ")")


def power_of_ten(exponent: Column) -> Column:
    """10 to a whole power from 0 to 12, exactly."""
    return F.get(F.expr("array(" + ", ".join(f"CAST({10**n} AS DECIMAL(13, 0))" for n in range(13)) + ")"), exponent)


def last_digit(decimals: Column) -> Column:
    """One unit of the last of so many decimals, of which 6 count at most."""
    return F.get(F.expr("array(" + ", ".join(f"CAST('{10**-n:.6f}' AS DECIMAL(7, 6))" for n in range(7)) + ")"), F.least(decimals, F.lit(6)))


def is_percent(unit: Column) -> Column:
    return F.coalesce(unit.isin(PERCENT_UNITS), F.lit(False))


def size_of(value: Column, scale: Column, unit: Column) -> Column:
    """What a figure amounts to, without its sign: basis points in percent, other percents and units as they stand."""
    v = value.cast("decimal(24,6)")
    return F.when(F.coalesce(unit == "bps", F.lit(False)), (v * F.lit("0.01").cast("decimal(3,2)")).cast(SIZE)).otherwise((v * power_of_ten(scale)).cast(SIZE))


def step_of(decimals: Column, scale: Column, unit: Column) -> Column:
    """One unit of the last shown digit, in the units of ``size_of``."""
    one = last_digit(decimals)
    scaled = (one * power_of_ten(scale)).cast(SIZE)
    return F.when(F.coalesce(unit == "bps", F.lit(False)), (one * F.lit("0.01").cast("decimal(3,2)")).cast(SIZE)).when(is_percent(unit), one.cast(SIZE)).otherwise(scaled)


def close_enough(mine: Column, step: Column, target: Column) -> Column:
    """Within half a unit of the last digit and at most 2 % apart; a target of 0 has only the first bound."""
    apart, half = F.abs(F.abs(mine) - F.abs(target)), (step * F.lit("0.5").cast("decimal(2,1)")).cast(SIZE)
    cap = (F.abs(target) * F.lit("0.02").cast("decimal(3,2)")).cast(SIZE)
    return (apart == 0) | ((apart <= half) & ((target == 0) | (apart <= cap)))


def close_to_display(mine: Column, step: Column, target: Column) -> Column:
    """For results of calculations: within half a unit of the last digit and at most 25 % apart."""
    apart, half = F.abs(F.abs(mine) - F.abs(target)), (step * F.lit("0.5").cast("decimal(2,1)")).cast(SIZE)
    return (apart <= half) & ((target == 0) | (apart <= (F.abs(target) * F.lit("0.25").cast("decimal(3,2)")).cast(SIZE)))


def currency_code(text: Column) -> Column:
    """The ISO code of a symbol or code as written; null for null or empty."""
    symbols = literal_map(CURRENCIES)
    t = F.trim(text)
    return F.when(t != "", F.coalesce(symbols[F.lower(t)], F.upper(t)))


def shown(value: Column, decimals: int) -> Column:
    """With thousands separators; halves are rounded away from zero."""
    return F.format_number(F.round(value, decimals), decimals)

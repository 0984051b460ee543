"""Formulas in decimals of 28 digits: every row has a result or the code of what went wrong.

Spark's decimals have a fixed number of places and lose digits in long products, so this is done in Python, a column of
Arrow at a time; a formula is parsed once per task.
"""

from __future__ import annotations

from decimal import Decimal, DecimalException, DivisionByZero, InvalidOperation, Overflow, localcontext
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from numerant.operators.calculation import tree

# Digits that count, and the largest exponent.
DIGITS, MOST_EXPONENT, MOST_PLACES = 28, 100, 12
_RESULT = pa.struct([("result", pa.string()), ("used_float", pa.bool_()), ("code", pa.string())])


class Fault(Exception):
    """What keeps a formula from having a result: unknown_name, division_by_zero, zero_power, large_exponent,
    negative_base, places, overflow, arithmetic or syntax."""


def value(node: tuple, inputs: dict[str, Decimal], floats: list) -> Decimal:
    """The value of a parsed formula; ``floats`` gets an entry for every power that only floating point can do."""
    kind, *parts = node
    if kind == "number":
        return Decimal(parts[0])
    if kind == "name":
        if inputs.get(parts[0]) is None:
            raise Fault("unknown_name")
        return inputs[parts[0]]
    if kind == "sign":
        v = value(parts[1], inputs, floats)
        return -v if parts[0] == "-" else v
    if kind == "call":
        return _called(parts[0], [value(p, inputs, floats) for p in parts[1:]])
    a, b = (value(p, inputs, floats) for p in parts)
    if kind == "/":
        if b == 0:
            raise Fault("division_by_zero")
        return a / b
    if kind == "**":
        return _power(a, b, floats)
    return a + b if kind == "+" else a - b if kind == "-" else a * b


def _called(name: str, values: list[Decimal]) -> Decimal:
    if name in ("min", "max"):
        return min(values) if name == "min" else max(values)
    if name == "abs":
        return abs(values[0])
    places = values[1] if len(values) > 1 else Decimal(0)
    if places != places.to_integral_value() or abs(places) > MOST_PLACES:
        raise Fault("places")
    return round(values[0], int(places))


def _power(a: Decimal, b: Decimal, floats: list) -> Decimal:
    if abs(b) > MOST_EXPONENT:
        raise Fault("large_exponent")
    if a == 0 and b <= 0:
        raise Fault("zero_power")
    if b == b.to_integral_value():
        return a ** int(b)
    if a < 0:
        raise Fault("negative_base")
    floats.append(b)
    return Decimal(repr(float(a) ** float(b)))


@cache
def parsed(formula: str) -> tuple | None:
    try:
        return tree(formula)
    except ValueError:
        return None


def computed(formula: str | None, inputs: list[tuple[str, Decimal]] | None) -> tuple[str | None, bool, str | None]:
    """Result (plain digits), whether floating point was used, and the code of a fault."""
    node, floats = parsed(formula) if formula is not None else None, []
    if node is None:
        return None, False, None if formula is None else "syntax"
    with localcontext(prec=DIGITS) as context:
        context.traps[DivisionByZero] = context.traps[InvalidOperation] = context.traps[Overflow] = True
        try:
            found = value(node, dict(inputs or []), floats)
            return (format(+found, "f"), bool(floats), None) if found.is_finite() else (None, bool(floats), "overflow")
        except Fault as fault:
            return None, bool(floats), str(fault)
        except (Overflow, OverflowError):
            return None, bool(floats), "overflow"
        except (DecimalException, ArithmeticError, ValueError, TypeError):
            return None, bool(floats), "arithmetic"


def exactly(formula: Column, inputs: Column) -> Column:
    """struct(result, used_float, code) of each row's formula over its ``inputs``, a map of names and decimals; a null formula
    has neither result nor code, and null inputs are unknown names."""

    def run(formulas: pa.Array, inputs: pa.Array) -> pa.Array:
        rows = [computed(f, m) for f, m in zip(formulas.to_pylist(), inputs.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(_RESULT)], fields=list(_RESULT))

    return F.arrow_udf(run, "result string, used_float boolean, code string")(formula, inputs)

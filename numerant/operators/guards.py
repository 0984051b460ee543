"""What a calculation may not do: rescale, multiply percentages by hand, show points as plain numbers, or take a root
that doesn't fit its years; and whether its inputs are what the cited blocks hold.

Formulas are few and checked on the driver before they run; inputs are rows, joined with the values of their blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerant.functions.numeric import is_percent
from numerant.operators.calculation import LITERALS, tree
from numerant.operators.figures import extract_figures
from numerant.sources.tables import large

# Scales that an input may declare.
DECLARED_SCALES = {"k": 3, "m": 6, "bn": 9}


def _nodes(node: tuple) -> Iterator[tuple]:
    yield node
    for part in node[1:]:
        if isinstance(part, tuple):
            yield from _nodes(part)


def _names(node: tuple) -> list[str]:
    return [n[1] for n in _nodes(node) if n[0] == "name"]


def _constant(node: tuple, known: dict[str, float]) -> float | None:
    """The value of a part that holds numbers and known names only, else None."""
    kind, *parts = node
    if kind == "number":
        return float(parts[0])
    if kind == "name":
        return known.get(parts[0])
    values = [_constant(p, known) for p in parts if isinstance(p, tuple)]
    if None in values:
        return None
    try:
        if kind == "sign":
            return -values[0] if parts[0] == "-" else values[0]
        if kind == "call":
            return float({"min": min, "max": max, "abs": lambda x: abs(x), "round": lambda x, n=0.0: round(x, int(n))}[parts[0]](*values))
        a, b = values
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "**": lambda: math.pow(a, b)}[kind]()
    except (ArithmeticError, ValueError, TypeError):
        return None


def constant_factor(node: tuple, known: dict[str, float]) -> float:
    """By how much constants scale the result: the product of all factors and divisors that are constant, outside
    exponents; zeros don't count."""
    kind, *parts = node
    if kind in ("number", "name", "**"):
        return 1.0
    if kind == "call" and parts[0] == "round":
        parts = parts[:2]
    sides = []
    for part in (p for p in parts if isinstance(p, tuple)):
        value = _constant(part, known) if kind in "*/" else None
        sides.append(constant_factor(part, known) if value is None else abs(value) or 1.0)
    return sides[0] / sides[1] if kind == "/" else math.prod(sides)


def guard_problems(formula: str, kind: str = "num", percents: tuple[str, ...] = (), years: dict[str, int] | None = None, known: dict[str, float] | None = None) -> list[str]:
    """Codes for what a formula may not do, in this order; none for one that may run.

    ``kind`` is how the result is shown (num, pct, money), ``percents`` the inputs that are percentages, ``years`` the
    column years of inputs, ``known`` the values of assumptions, which count as constants.
    pct_factor: shown as a percentage, and constants scale it by 100 or more, or by 1/100 or less.
    rescale: all it does is to move one input by three or more powers of ten.
    points: adds or subtracts percentages only, but isn't shown as a percentage.
    span: the n of a 1/n root isn't the number of years between the inputs under it.
    """
    known, years, root = known or {}, years or {}, tree(formula)
    out, factor = [], constant_factor(root, known)
    if kind == "pct" and abs(math.log10(factor)) >= 2 - 1e-12:
        out.append("pct_factor")
    free = [n for n in _names(root) if n not in known]
    steps = [n for n in _nodes(root) if n[0] not in ("number", "name", "sign")]
    power = math.log10(factor)
    if len(free) == 1 and all(n[0] in "*/" or n[:2] == ("call", "abs") for n in steps) and abs(power - round(power)) < 1e-9 and abs(power) >= 3 - 1e-9:
        out.append("rescale")
    operators = [n[0] for n in steps if n[0] != "call"]
    if kind != "pct" and operators and set(operators) <= {"+", "-"} and set(_names(root)) <= set(percents):
        out.append("points")
    for node in (n for n in _nodes(root) if n[0] == "**"):
        exponent = _constant(node[2], known)
        if exponent is None or not 0 < abs(exponent) < 1 or abs(1 / abs(exponent) - round(1 / abs(exponent))) > 0.001:
            continue
        seen = {years[n] for n in _names(node[1]) if years.get(n) is not None}
        if len(seen) > 1 and max(seen) - min(seen) != round(1 / abs(exponent)) and "span" not in out:
            out.append("span")
    return out


def guarded(formula: Column, kind: Column, percents: Column, years: Column) -> Column:
    """``guard_problems`` of each row's formula, joined by commas; null for what is no formula. ``percents`` is an array of
    names, ``years`` a map of them to the year of their column."""

    def told(formulas: pd.Series, kinds: pd.Series, percents: pd.Series, years: pd.Series) -> pd.Series:
        out = []
        for f, k, p, y in zip(formulas, kinds, percents, years, strict=True):
            try:
                out.append(",".join(guard_problems(f, k, tuple(p), {n: int(v) for n, v in dict(y).items()})))
            except (ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype="string")

    return F.pandas_udf(told, "string")(formula, kind, percents, years)


def resolved_inputs(inputs: DataFrame, values: DataFrame) -> DataFrame:
    """Inputs of calculations against the blocks they cite: calc_id, name, base, problem, unit, is_percent, currency,
    scale, year, matched. One row per input; base is null where there is a problem, which is the first that applies:

    no_source, not_one_number, unknown_scale, no_reason (assumptions other than whole numbers up to 12 and 0.5),
    unknown_source, not_found, percent, unit, sign, currency, scale.

    ``inputs``: calc_id, name, value (as written), scale, source (a block, or ``assumption``), reason; calc_id and name
    tell inputs apart. ``values``: see ``block_values``. The join is on the block and the number, and what fits is
    counted where the rows lie.
    """
    keyed = inputs.select("calc_id", "name", "value", F.lower("scale").alias("declared"), "source", "reason", F.to_json(F.struct("calc_id", "name")).alias("_id"))
    found = extract_figures(keyed.select("_id", "value"), "_id", "value", exempt=False)
    one = found.groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("unparsed").alias("glued"), F.first(F.struct("value", "neg", "scale", "unit", "currency")).alias("f"))
    blocks = values.select(F.col("block").alias("source"), F.lit(True).alias("there")).distinct()
    asked = keyed.join(large(one), "_id", "left").join(large(blocks), "source", "left")
    v = values.select("block", "pos", F.col("raw").alias("v_raw"), F.col("value").alias("v_value"), F.struct("unit", "neg", "scale", "currency", "year").alias("v"))
    pairs = asked.select("_id", "source", "f").join(large(v), (F.col("source") == F.col("block")) & (F.col("f.value") == F.col("v_value")))
    same_kind = is_percent(F.col("f.unit")) == is_percent(F.col("v.unit"))
    stated = F.col("f.unit").isNotNull() | F.col("f.currency").isNotNull() | (F.col("f.scale") > 0)
    unit = same_kind & (is_percent(F.col("f.unit")) | ~stated | F.col("f.unit").eqNullSafe(F.col("v.unit")))
    sign = unit & (~F.col("f.neg") | F.col("v.neg"))
    currency = sign & (F.col("f.currency").isNull() | F.col("v.currency").isNull() | (F.col("f.currency") == F.col("v.currency")))
    fits = pairs.groupBy("_id").agg(
        F.bool_or(same_kind).alias("same_kind"), F.bool_or(unit).alias("same_unit"), F.bool_or(sign).alias("same_sign"), F.bool_or(currency).alias("same_currency"),
        F.min_by(F.struct("v.*", "v_raw"), F.when(currency, F.col("pos"))).alias("v"), F.when(F.count_distinct(F.when(currency, F.col("v.year"))) == 1, F.max(F.when(currency, F.col("v.year")))).alias("year"),
    )
    scales = F.create_map(*[F.lit(x) for pair in DECLARED_SCALES.items() for x in pair])
    declared = F.when(F.coalesce("declared", F.lit("")) == "", 0).otherwise(scales[F.col("declared")])
    assumed = F.col("source") == "assumption"
    unit_of = F.coalesce("f.unit", F.when(~assumed, F.col("v.unit")))
    own = F.when(unit_of.isNotNull(), 0).otherwise(F.when(F.col("f.scale") > 0, F.col("f.scale")).otherwise(declared))
    block_scale = F.when(unit_of.isNotNull() | assumed, 0).otherwise(F.coalesce("v.scale", F.lit(0)))
    literal = F.col("f.value").isin([float(x) for x in LITERALS]) & F.col("f.unit").isNull() & F.col("f.currency").isNull() & (F.col("f.scale") == 0) & (declared == 0)
    problem = (
        F.when(F.coalesce("source", F.lit("")) == "", "no_source")
        .when((F.coalesce("n", F.lit(0)) != 1) | F.col("glued"), "not_one_number")
        .when(declared.isNull(), "unknown_scale")
        .when(assumed, F.when(~literal & (F.coalesce("reason", F.lit("")) == ""), "no_reason"))
        .when(F.col("there").isNull(), "unknown_source")
        .when(F.col("same_kind").isNull(), "not_found").when(~F.col("same_kind"), "percent").when(~F.col("same_unit"), "unit").when(~F.col("same_sign"), "sign").when(~F.col("same_currency"), "currency")
        .when((own > 0) & (block_scale > 0) & (own != block_scale), "scale")
    )
    exponent = F.when(block_scale > 0, block_scale).otherwise(own)
    sized = F.col("f.value").cast("double") * F.when(unit_of == "bps", 0.0001).when(is_percent(unit_of), 0.01).otherwise(F.pow(F.lit(10.0), exponent))
    base = F.when(F.col("f.neg"), -sized).otherwise(sized)
    money = F.when(unit_of.isNull(), F.coalesce("f.currency", F.when(~assumed, F.col("v.currency"))))
    return asked.join(large(fits), "_id", "left").withColumn("problem", problem).select(
        "calc_id", "name", F.when(F.col("problem").isNull(), base).alias("base"), "problem", unit_of.alias("unit"), is_percent(unit_of).alias("is_percent"), money.alias("currency"),
        exponent.alias("scale"), "year", F.col("v.v_raw").alias("matched"),
    )

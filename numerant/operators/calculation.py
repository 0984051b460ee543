"""Calculations over cited inputs: formulas are Spark expressions, checked before they run.

A formula has names of inputs, whole numbers up to 12 and 0.5, ``+ - * /``, ``**``, ``min``, ``max``, ``abs`` and
``round``. It is compiled once into a column over the inputs of all calculations that use it; errors become codes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What formulas may hold.
LITERALS = {"0.5", *(str(n) for n in range(13))}
CALLS = {"min": "least", "max": "greatest", "abs": "abs", "round": "bround"}
TOKEN = re.compile(r"\s*(\*\*|[A-Za-z_]\w*|\d+(?:\.\d+)?|[-+*/(),])")
MOST_CHARS = 500


def tokens_of(formula: str) -> list[str] | None:
    """The tokens of a formula; None if something else is in it."""
    out, at = [], 0
    text = formula.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        out.append(m[1])
        at = m.end()
    return out


def problems(formula: str, names: list[str], documents: list[str]) -> list[str]:
    """Codes for what is wrong with a formula: too_long, syntax, unknown_name, duplicate_name, unused_input,
    literal (a number that isn't allowed), no_document_input."""
    out = []
    if len(formula) > MOST_CHARS:
        out.append("too_long")
    tokens = tokens_of(formula)
    try:
        as_sql(formula)
    except ValueError:
        return [*out, "syntax"]
    used = {t for t in tokens if re.match(r"[A-Za-z_]", t)} - set(CALLS)
    if used - set(names):
        out.append("unknown_name")
    if len(set(names)) < len(names):
        out.append("duplicate_name")
    if set(names) - used:
        out.append("unused_input")
    if any(re.match(r"\d", t) and t not in LITERALS for t in tokens):
        out.append("literal")
    if not set(documents) & used:
        out.append("no_document_input")
    return out


def tree(formula: str) -> tuple:
    """The formula as nested tuples: ("number", text), ("name", name), ("sign", sign, x), ("call", function, x, ...) and
    (operator, left, right); ValueError if it isn't a formula."""
    tokens = tokens_of(formula)
    if tokens is None:
        raise ValueError(f"not a formula: {formula}")
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def chain(lower, ops: str) -> tuple:
        left = lower()
        while peek() and peek() in ops:
            left = (take(), left, lower())
        return left

    def total() -> tuple:
        return chain(lambda: chain(signed, "*/"), "+-")

    def signed() -> tuple:
        if peek() in ("-", "+"):
            return ("sign", take(), signed())
        base = atom()
        if peek() != "**":
            return base
        take()
        return ("**", base, signed())

    def atom() -> tuple:
        t = take() if peek() else ""
        if t == "(":
            inner = total()
        elif t in CALLS and peek() == "(":
            take()
            args = [total()]
            while peek() == ",":
                take()
                args.append(total())
            inner = ("call", t, *args)
        elif re.match(r"\d", t):
            return ("number", t)
        elif re.match(r"[A-Za-z_]", t):
            return ("name", t)
        else:
            raise ValueError(f"not a formula: {formula}")
        if peek() != ")":
            raise ValueError(f"not a formula: {formula}")
        take()
        return inner

    out = total()
    if at < len(tokens):
        raise ValueError(f"not a formula: {formula}")
    return out


def _sql(node: tuple) -> str:
    kind, *parts = node
    if kind == "number":
        return f"{parts[0]}D"
    if kind == "name":
        return f"`{parts[0]}`"
    if kind == "sign":
        return f"({parts[0]}{_sql(parts[1])})"
    if kind == "call":
        name, first, *rest = parts[0], *map(_sql, parts[1:])
        if name == "round":
            return f"bround({first}, {f'CAST({rest[0]} AS INT)' if rest else 0})"
        return f"{CALLS[name]}({', '.join([first, *rest])})"
    left, right = map(_sql, parts)
    if kind == "**":
        return f"(CASE WHEN abs({right}) <= 100 AND ({left} <> 0 OR {right} > 0) AND ({left} >= 0 OR {right} = round({right})) THEN power({left}, {right}) END)"
    return f"try_divide({left}, {right})" if kind == "/" else f"({left} {kind} {right})"


def as_sql(formula: str) -> str:
    """The formula as a Spark SQL expression over columns of type double; ValueError if it isn't one."""
    return _sql(tree(formula))


def compiled(formula: str) -> Column:
    """The formula as a column; null where it can't be computed (division by zero, 0 to a power that isn't positive, a
    result that isn't finite)."""
    result = F.expr(as_sql(formula))
    return F.when(F.abs(result) < float("inf"), result)


def evaluated(inputs: DataFrame, formulas: dict[str, str], formula: str = "formula", result: str = "result") -> DataFrame:
    """``inputs`` with the result of the formula that each row names; null for unknown names and for errors.

    The catalogue of formulas is small and known beforehand: it becomes one CASE over the row's columns.
    """
    out = F.lit(None).cast("double")
    for name, text in formulas.items():
        out = F.when(F.col(formula) == name, compiled(text)).otherwise(out)
    return inputs.withColumn(result, out)


def formula_problems(formula: Column, names: Column, documents: Column) -> Column:
    """``problems`` of each row's formula, joined by commas; null for a null formula. ``names`` and ``documents`` are arrays
    of the inputs' names, and of those that come from documents."""

    def told(formulas: pd.Series, names: pd.Series, documents: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else ",".join(problems(f, list(n), list(d))) for f, n, d in zip(formulas, names, documents, strict=True)], dtype="string")

    return F.pandas_udf(told, "string")(formula, names, documents)


def identifier(name: Column) -> Column:
    """A name that formulas may hold, made of any text: letters and digits in lower case, all else as one underline between
    them; ``x_`` before a digit or nothing."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", ""))
    return F.when(plain.rlike(r"^[a-z_]"), plain).otherwise(F.concat(F.lit("x_"), plain))


def renamed(formula: Column, names: Column) -> tuple[Column, Column]:
    """A formula with the ``names`` (an array) that it can't hold replaced by identifiers, the longest first, so that names
    may hold each other; and the array of what was renamed (old, new). Names with the same identifier are told apart
    by a number, in their order."""
    bad = F.array_distinct(F.filter(names, lambda n: ~n.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")))
    made = F.transform(bad, lambda n: F.struct(n.alias("old"), identifier(n).alias("slug")))

    def numbered(pair: Column, k: Column) -> Column:
        before = F.size(F.filter(F.slice(made, F.lit(1), k), lambda other: other["slug"] == pair["slug"]))
        return F.struct(pair["old"].alias("old"), F.when(before > 0, F.concat(pair["slug"], F.lit("_"), (before + 1).cast("string"))).otherwise(pair["slug"]).alias("new"))

    pairs = F.transform(made, numbered)
    longest = F.array_sort(pairs, lambda a, b: F.coalesce(F.nullif(F.length(b["old"]) - F.length(a["old"]), F.lit(0)), F.when(a["old"] < b["old"], -1).otherwise(1)))
    return F.aggregate(longest, formula, lambda text, pair: F.replace(text, pair["old"], pair["new"])), pairs


def displayed(value: Column, kind: str = "num", currency: str = "", suffix: str = "") -> Column:
    """A result as it is shown: percentages with at least one decimal and three significant digits, money with two
    decimals, other numbers with three significant digits; halves away from zero."""
    v = value * 100 if kind == "pct" else value
    size = F.abs(v)
    significant = F.when(size == 0, 0).otherwise(F.greatest(F.lit(0), 2 - F.floor(F.log10(size)).cast("int")))
    places = F.lit(2) if kind == "money" else F.greatest(F.lit(1), significant) if kind == "pct" else significant
    text = F.lit(None).cast("string")
    for n in range(10):
        text = F.when(places == n, F.format_number(F.round(size, n), n)).otherwise(text)
    sign = F.when(v < 0, "-").otherwise("")
    return F.concat(sign, F.lit(currency), text, F.lit("%" if kind == "pct" else suffix))

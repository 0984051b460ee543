"""Guards of formulas and inputs of calculations."""

import pytest

from numerant.operators.blocks import block_values
from numerant.operators.calculation import as_sql
from numerant.operators.guards import constant_factor, guard_problems, resolved_inputs, tree

TABLE = "| | 2022 GBPm | 2023 GBPm |\n|---|---|---|\n| Revenue | 8,553 | 9,161 |\n| Costs | (205) | (323) |\n| Margin | 24.0% | 25.0% |\n| EPS | 85.2p | 94.1p |"


@pytest.mark.parametrize(
    ("formula", "options", "want"),
    [
        ("(a - b) / b", {"kind": "pct"}, []), ("(a - b) / b * 10 * 10", {"kind": "pct"}, ["pct_factor"]), ("a / b / hundred", {"kind": "pct", "known": {"hundred": 100.0}}, ["pct_factor"]),
        ("a / b * 10", {"kind": "pct"}, []), ("a / 10 / 10 / 10", {}, ["rescale"]), ("abs(a) * thousand", {"known": {"thousand": 1000.0}}, ["rescale"]), ("a / 10 / 10", {}, []), ("a / b / 10 / 10 / 10", {}, []),
        ("round(a / thousand)", {"known": {"thousand": 1000.0}}, []), ("a - b", {"percents": ("a", "b")}, ["points"]), ("a - b", {"kind": "pct", "percents": ("a", "b")}, []), ("a / b", {"percents": ("a", "b")}, []),
        ("a - c", {"percents": ("a",)}, []), ("(a / b) ** (1 / 3) - 1", {"years": {"a": 2024, "b": 2022}}, ["span"]), ("(a / b) ** (1 / 2) - 1", {"years": {"a": 2024, "b": 2022}}, []),
        ("(a / b) ** (1 / n) - 1", {"years": {"a": 2024, "b": 2022}, "known": {"n": 3.0}}, ["span"]), ("(a / b) ** (1 / 3)", {"years": {"a": 2024}}, []), ("a ** 2", {"years": {"a": 2024, "b": 2020}}, []),
        ("a ** (1 / 0)", {}, []), ("a * 0", {"kind": "pct"}, []),
    ],
)
def test_guards(formula, options, want):
    assert guard_problems(formula, **options) == want


def test_trees():
    assert tree("-a ** 2") == ("sign", "-", ("**", ("name", "a"), ("number", "2"))) and as_sql("a - b - 1") == "((`a` - `b`) - 1.0D)".replace("1.0D", "1D")
    assert constant_factor(tree("(a + b) * 2 / 8"), {}) == 0.25


def test_inputs(spark):
    values = block_values(spark.createDataFrame([("B1", TABLE)], "block string, text string"))
    rows = [
        ("r", "8,553", None, "B1", None), ("million", "£8,553m", None, "B1", None), ("cost", "(205)", "m", "B1", None), ("share", "24.0%", None, "B1", None), ("eps", "85.2p", None, "B1", None),
        ("none", "1", None, None, None), ("two", "1 and 2", None, "B1", None), ("declared", "8,553", "tn", "B1", None), ("assumed", "37", None, "assumption", None), ("told", "37", None, "assumption", "a guess"),
        ("small", "12", None, "assumption", None), ("block", "8,553", None, "B2", None), ("absent", "8,554", None, "B1", None), ("percent", "24.0", None, "B1", None), ("unit", "£85.2", None, "B1", None),
        ("sign", "-8,553", None, "B1", None), ("currency", "$8,553", None, "B1", None), ("scale", "8,553", "bn", "B1", None), ("null", None, None, "B1", None),
    ]
    inputs = spark.createDataFrame([("C1", *r) for r in rows], "calc_id string, name string, value string, scale string, source string, reason string")
    got = {r.name: r for r in resolved_inputs(inputs, values).collect()}
    assert {n: r.problem for n, r in got.items() if r.problem} == {
        "none": "no_source", "two": "not_one_number", "declared": "unknown_scale", "assumed": "no_reason", "block": "unknown_source", "absent": "not_found", "percent": "percent", "unit": "unit",
        "sign": "sign", "currency": "currency", "scale": "scale", "null": "not_one_number",
    }
    assert {n: r.base for n, r in got.items() if not r.problem} == pytest.approx({"r": 8553e6, "million": 8553e6, "cost": -205e6, "share": 0.24, "eps": 85.2, "told": 37.0, "small": 12.0})
    assert (got["r"].year, got["r"].currency, got["share"].is_percent, got["eps"].unit, got["told"].matched) == (2022, "GBP", True, "p", None)
    assert resolved_inputs(inputs.limit(0), values).count() == 0

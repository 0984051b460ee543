"""Tolerances, matches, near misses, hints, statuses."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from numerant.functions.numeric import close_enough, close_to_display, currency_code, size_of, step_of
from numerant.operators.matching import cited_matches, matches, near_misses, where_hints
from numerant.operators.status import best_status, figure_statuses

SCHEMA = "figure_id int, block string, value decimal(24,6), neg boolean, scale int, unit string, currency string, decimals int"
BLOCK = "block string, block_no long, pos int, value decimal(24,6), neg boolean, scale int, unit string, currency string, decimals int"


def sized(df):
    return df.withColumns({"size": size_of(F.col("value"), F.col("scale"), F.col("unit")), "step": step_of(F.col("decimals"), F.col("scale"), F.col("unit"))})


def figures(spark, rows):
    return sized(spark.createDataFrame([(i, b, Decimal(v), *r) for i, (b, v, *r) in enumerate(rows)], SCHEMA))


def blocks(spark, rows):
    return sized(spark.createDataFrame([(b, n, p, Decimal(v), *r) for b, n, p, v, *r in rows], BLOCK))


def test_tolerances(spark):
    cases = [("9.4", "0.1", "9.434", True, True), ("9.4", "0.1", "9.451", False, False), ("9", "1", "9.4", False, True), ("0", "1", "0", True, True), ("0", "1", "0.4", False, False), ("5", "1", "0", False, False), ("-9.4", "0.1", "9.434", True, True)]
    rows = spark.createDataFrame([tuple(map(Decimal, c[:3])) for c in cases], "a decimal(38,6), s decimal(38,6), t decimal(38,6)")
    got = rows.select(close_enough(F.col("a"), F.col("s"), F.col("t")), close_to_display(F.col("a"), F.col("s"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [c[3:] for c in cases]


def test_currencies(spark):
    rows = spark.createDataFrame([("£",), ("us$",), ("gbp ",), ("",), (None,)], "c string")
    assert [r[0] for r in rows.select(currency_code(F.col("c"))).collect()] == ["GBP", "USD", "GBP", None, None]


def test_statuses_and_near_misses(spark):
    held = blocks(spark, [("B1", 1, 0, "20269", False, 6, None, "USD", 0), ("B1", 1, 1, "173.2", False, 0, "c", None, 1), ("B1", 1, 2, "315", True, 6, None, "USD", 0)])
    asked = figures(spark, [
        ("B1", "20269", False, 6, None, "USD", 0), ("B1", "20.3", False, 9, None, "USD", 1), ("B1", "20269", False, 6, None, "GBP", 0), ("B1", "20269", False, 3, None, "USD", 0),
        ("B1", "173.2", False, 0, "p", None, 1), ("B1", "173.2", False, 0, "c", None, 1), ("B1", "315", False, 6, None, "USD", 0), ("B1", "20269", True, 6, None, "USD", 0), ("B9", "1", False, 0, None, None, 0), (None, "1", False, 0, None, None, 0), ("B1", "777", False, 6, None, "USD", 0),
    ])
    got = {r.figure_id: r.status for r in figure_statuses(asked, held).collect()}
    assert [got[k] for k in range(11)] == ["traced", "traced", "mismatch", "mismatch", "mismatch", "traced", "traced", "mismatch", "phantom", "untraced", "mismatch"]
    near = {r.figure_id: (r.kinds, float(r.near)) for r in near_misses(asked.filter("figure_id in (2, 3, 4, 7, 10)"), held, "block").collect()}
    assert near == {2: (["currency"], 20269.0), 3: (["scale"], 20269.0), 4: (["unit"], 173.2), 7: (["sign"], 20269.0)}


def test_hints_are_those_of_the_nested_loop(spark):
    rng = random.Random(5)

    def row():
        d = rng.randint(0, 2)
        unit = rng.choice([None, None, "%", "bps", "p"])
        return (f"{rng.choice([0, 1.25, 9.5, 20.25, 202.5, 2025]) + rng.choice([0, 0.01, 0.04, 0.3]):.{d}f}", rng.random() < 0.2, rng.choice([0, 0, 3, 6]) if unit is None else 0, unit, rng.choice([None, "USD", "GBP"]) if unit is None else None, d)

    asked = figures(spark, [(None, *row()) for _ in range(120)])
    held = blocks(spark, [(f"B{k}", k, 0, *row()) for k in range(150)])
    pairs = asked.alias("f").crossJoin(held.alias("b")).filter(matches()).select("f.figure_id", "b.block_no").distinct().collect()
    want = {}
    for f, b in sorted(map(tuple, pairs)):
        want.setdefault(f, []).append(b)
    got = {r.figure_id: r.found for r in where_hints(asked, held).collect()}
    assert got == {f: b[:3] for f, b in want.items()} and len(got) > 50


def test_hints_name_the_first_three_blocks(spark):
    held = blocks(spark, [(f"B{k}", k, 0, "1234.5", False, 0, None, "USD", 1) for k in (5, 2, 9, 7)] + [("B1", 1, 0, "99", False, 0, None, "USD", 0)])
    asked = figures(spark, [(None, "1234.5", False, 0, None, "USD", 1)])
    assert [(r.figure_id, r.found) for r in where_hints(asked, held).collect()] == [(0, [2, 5, 7])]


def test_best_status(spark):
    rows = spark.createDataFrame([(1, 0, "phantom"), (1, 1, "mismatch"), (2, 0, "mismatch"), (2, 1, "traced"), (3, 0, "mismatch"), (3, 1, "derived_needs_calc")], "k int, pos int, status string")
    assert sorted(map(tuple, best_status(rows, "k").collect())) == [(1, "mismatch"), (2, "traced"), (3, "derived_needs_calc")]


def test_empty_tables(spark):
    none = figures(spark, [])
    assert cited_matches(none, blocks(spark, []), "block").count() == 0
    assert near_misses(none, blocks(spark, []), "block").count() == 0

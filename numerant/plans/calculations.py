"""Queries over calculations: margins, growth, rates, rounding, checks of formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numerant.functions.numeric import shown
from numerant.operators.calculation import displayed, evaluated, formula_problems
from numerant.operators.claims import amount, order_blocks
from numerant.operators.guards import guarded, resolved_inputs
from numerant.operators.results import change_signs, dimension, output_line, with_units
from numerant.sources.tables import table

FORMULAS = {
    "margin": "(revenue - cost) / revenue",
    "growth": "after / before - 1",
    "cagr": "(after / before) ** (1 / years) - 1",
}


def q22_calc_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount margin by part of the lineitem table's flag and status."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"))
    out = evaluated(sums.withColumn("formula", F.lit("margin")), {"margin": FORMULAS["margin"]})
    return out.select("l_returnflag", "l_linestatus", F.round("result", 8).alias("margin"), displayed(F.round("result", 8), "pct").alias("shown"))


def _by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return orders.groupBy("year").agg(F.sum("p").cast("double").alias("total"))


def q23_calc_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, then = _by_year(spark, sf_dir), _by_year(spark, sf_dir).select((F.col("year") + 1).alias("year"), F.col("total").alias("before"))
    pairs = now.join(then, "year").withColumnRenamed("total", "after").withColumn("formula", F.lit("growth"))
    return evaluated(pairs, {"growth": FORMULAS["growth"]}).select("year", F.round("result", 8).alias("growth"))


def q24_calc_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _by_year(spark, sf_dir).agg(F.min("year").alias("y0"), F.min_by("total", "year").alias("before"))
    rows = _by_year(spark, sf_dir).crossJoin(F.broadcast(first)).filter("year > y0")  # one row, broadcast
    rows = rows.select("year", F.col("total").alias("after"), "before", (F.col("year") - F.col("y0")).cast("double").alias("years"), F.lit("cagr").alias("formula"))
    return evaluated(rows, {"cagr": FORMULAS["cagr"]}).select("year", F.round("result", 8).alias("cagr"))


def q25_calc_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min, max, abs and round, which goes to the even neighbour."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_tax") * 100).alias("b"))
    rows = rows.withColumn("a", F.col("a") / 2)
    made = rows
    for name, text in (("low", "min(a, b)"), ("high", "max(a, b)"), ("apart", "abs(a - b)"), ("even", "round(a)")):
        made = evaluated(made.withColumn("formula", F.lit(name)), {name: text}, result=name)
    return made.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("low", "high", "apart", "even")])


def q26_calc_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two percentages, in points, by line status."""
    shares = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.count_if(F.col("l_discount") >= 0.05) / F.count(F.lit(1))).alias("deep"), (F.count_if(F.col("l_tax") >= 0.05) / F.count(F.lit(1))).alias("taxed"))
    out = evaluated(shares.withColumn("formula", F.lit("pp")), {"pp": "deep - taxed"})
    return out.select("l_returnflag", F.round("result", 8).alias("points"), displayed(F.round("result", 8), "pct").alias("shown"))


def _formulas(spark: SparkSession, sf_dir: str, cases: list[tuple]) -> DataFrame:
    """A calculation for each order: the formula of its case, with a literal of its own where there is one."""
    case = F.col("o_orderkey") % len(cases)
    text = F.lit(cases[-1][0])
    for k, (formula, *_) in enumerate(cases[:-1]):
        text = F.when(case == k, F.replace(F.lit(formula), F.lit("#"), (F.col("o_orderkey") + 20).cast("string"))).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", case.cast("int").alias("case"), text.alias("formula"))


def _by_case(values: list) -> Column:
    return F.element_at(F.array(*values), F.col("case") + 1)


PROBLEM_CASES = [("(a - b) / b", ["a", "b"], ["a", "b"], ""), ("a * #", ["a"], ["a"], "literal"), ("a +", ["a"], ["a"], "syntax"), ("a + c", ["a", "b"], ["a"], "unknown_name,unused_input"), ("import os", ["a"], ["a"], "syntax"), ("2 * 3", ["a"], [], "unused_input,no_document_input"), ("a.b", ["a"], ["a"], "syntax")]
POWER_CASES = [("a / b", 0), ("a - b", 1), ("a * n", 1), ("a + n", None), ("a * b", 2), ("n / a", -1), ("round(a + b, n)", 1), ("(a / b) ** n", 0), ("a ** 2", None), ("max(a, b, u)", None)]
GUARD_CASES = [("(a - b) / b", "pct", ""), ("(a - b) / b * 10 * 10", "pct", "pct_factor"), ("a / 10 / 10 / 10", "num", "rescale"), ("a - b", "num", "points"), ("a - b", "pct", ""), ("(a / b) ** (1 / 3) - 1", "pct", "span"), ("(a / b) ** (1 / 2) - 1", "pct", "")]


def q27_calc_static_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    rows = _formulas(spark, sf_dir, PROBLEM_CASES)
    found = formula_problems(F.col("formula"), _by_case([texts(c[1]) for c in PROBLEM_CASES]), _by_case([texts(c[2]) for c in PROBLEM_CASES]))
    return rows.select("o_orderkey", found.alias("problems"))


def q28_money_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a and b are amounts, n a number, u unknown."""
    rows = _formulas(spark, sf_dir, POWER_CASES)
    names, dims = F.array(*map(F.lit, "abnu")), F.array(F.lit(1), F.lit(1), F.lit(0), F.lit(None).cast("int"))
    return rows.select("o_orderkey", dimension(F.col("formula"), names, dims).alias("power"))


def q49_resolved_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of orders as inputs of calculations: written rightly, with the wrong currency, scale, source and so on."""
    orders = table(spark, sf_dir, "orders")
    case, total = F.col("o_orderkey") % 8, shown(amount("o_totalprice"), 2)
    block = F.concat(F.lit("D"), F.col("o_orderkey"), F.lit(":p1:b1"))
    inputs = orders.select(
        F.col("o_orderkey").alias("calc_id"), F.lit("total").alias("name"), F.when(case == 1, F.concat(F.lit("$"), total)).when(case == 2, F.concat(F.lit("£"), total)).when(case == 3, F.concat(total, F.lit("%"))).otherwise(total).alias("value"),
        F.when(case == 7, "tn").alias("scale"), F.when(case == 5, "assumption").when(case == 6, F.concat(F.lit("D0:p1:b"), F.col("o_orderkey"))).when(case != 4, block).alias("source"), F.lit(None).cast("string").alias("reason"),
    )
    return resolved_inputs(inputs, order_blocks(orders).withColumn("raw", F.col("value").cast("string"))).select(F.col("calc_id").alias("o_orderkey"), F.round("base", 2).alias("base"), "problem")


def q50_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a and b are percentages of the columns of 2024 and 2022."""
    rows = _formulas(spark, sf_dir, GUARD_CASES)
    found = guarded(F.col("formula"), _by_case([F.lit(c[1]) for c in GUARD_CASES]), F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit(2024), F.lit("b"), F.lit(2022)))
    return rows.select("o_orderkey", found.alias("problems"))


def q55_result_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the difference, ratio or share of an order's total and its balance is in: dollars in thousands, pence, or
    two currencies, with units asked for that fit or don't."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", amount("o_totalprice").cast("double").alias("p"))
    k = F.col("o_orderkey") % 8
    nothing = F.lit(None).cast("string")

    def entry(name: str, base: Column, kind: Column, unit: Column, currency: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), base.alias("base"), kind.alias("kind"), unit.alias("unit"), currency.alias("currency"), F.lit(3).alias("scale"), F.concat(F.lit("D"), F.col("o_orderkey"), F.lit(":p1:b1")).alias("source"), F.lit("Total").alias("row"))

    unit = F.when(k.isin(2, 3), "p")
    currency = F.when(~k.isin(2, 3), "USD")
    first = entry("a", -F.col("p"), nothing, unit, currency)
    second = entry("b", -F.col("p") / 2 - 1000, nothing, unit, F.when(k == 4, "GBP").otherwise(currency))
    rows = orders.select(
        "o_orderkey", "p", F.when(k == 1, "a / b").otherwise("a - b").alias("formula"), F.when(k == 1, "pct").otherwise("num").alias("kind"), F.array(first, second).alias("inputs"),
        F.when(k == 3, "c").when(k == 5, "x").when(k == 6, "GBPm").when(k == 7, "parsecs").alias("unit"),
        (-F.col("p") / 2 + 1000).alias("result"), (F.col("p") / 2 - 1000).alias("of_sizes"),
    )
    out = change_signs(with_units(rows), "result", "of_sizes")
    line = output_line(F.lit("C1"), F.format_number(F.abs("result"), 0), F.slice("inputs", 1, 1))
    return out.select("o_orderkey", "dim", "unit", "currency", "scale", "problem", "sign_basis", "change_sign", F.md5(line).alias("line"))


_PCT = """CASE WHEN {0} < 0 THEN '-' ELSE '' END || CASE WHEN abs({0}) >= 0.1 OR {0} = 0 THEN format('{{:,.1f}}', round(abs({0}) * 100, 1)) WHEN abs({0}) >= 0.01 THEN format('{{:,.2f}}', round(abs({0}) * 100, 2))
 WHEN abs({0}) >= 0.001 THEN format('{{:,.3f}}', round(abs({0}) * 100, 3)) ELSE format('{{:,.4f}}', round(abs({0}) * 100, 4)) END || '%'"""



def _cases(values: list) -> str:
    told = ["NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return f"CASE o_orderkey % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(told)) + " END"


SQL = {
    "q22_calc_margin": f"""WITH s AS (SELECT l_returnflag, l_linestatus, round((sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount))) / sum(l_extendedprice), 8) AS margin FROM lineitem GROUP BY ALL)
 SELECT l_returnflag, l_linestatus, margin, {_PCT.format("margin")} AS shown FROM s""",
    "q23_calc_growth": """WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL)
 SELECT a.year, round(a.total / b.total - 1, 8) AS growth FROM y a JOIN y b ON a.year = b.year + 1""",
    "q24_calc_cagr": """WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL), f AS (SELECT min(year) AS y0, arg_min(total, year) AS before FROM y)
 SELECT year, round(pow(total / before, 1.0 / (year - y0)) - 1, 8) AS cagr FROM y, f WHERE year > y0""",
    "q25_calc_functions": """SELECT l_orderkey, l_linenumber, round(least(l_quantity / 2, l_tax * 100), 6) AS low, round(greatest(l_quantity / 2, l_tax * 100), 6) AS high,
 round(abs(l_quantity / 2 - l_tax * 100), 6) AS apart, round(round_even(l_quantity / 2, 0), 6) AS even FROM lineitem""",
    "q26_calc_pp": f"""WITH s AS (SELECT l_returnflag, round(count(*) FILTER (WHERE l_discount >= 0.05) / count(*) - count(*) FILTER (WHERE l_tax >= 0.05) / count(*), 8) AS points FROM lineitem GROUP BY ALL)
 SELECT l_returnflag, points, {_PCT.format("points")} AS shown FROM s""",
    "q27_calc_static_problems": "SELECT o_orderkey, " + _cases([c[3] for c in PROBLEM_CASES]) + " AS problems FROM orders",
    "q28_money_dim": "SELECT o_orderkey, CAST(" + _cases([c[1] for c in POWER_CASES]) + " AS INTEGER) AS power FROM orders",
    "q49_resolved_inputs": """SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 2 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS base,
 CASE o_orderkey % 8 WHEN 2 THEN 'currency' WHEN 3 THEN 'percent' WHEN 4 THEN 'no_source' WHEN 5 THEN 'no_reason' WHEN 6 THEN 'unknown_source' WHEN 7 THEN 'unknown_scale' END AS problem FROM orders""",
    "q50_guards": "SELECT o_orderkey, " + _cases([c[2] for c in GUARD_CASES]) + " AS problems FROM orders",
    "q55_result_units": """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS p FROM orders)
 SELECT o_orderkey, CAST(CASE WHEN k IN (0, 4, 5, 6, 7) THEN 1 WHEN k = 1 THEN 0 END AS INTEGER) AS dim, CASE WHEN k = 2 THEN 'p' END AS unit, CASE WHEN k = 0 THEN 'USD' WHEN k = 6 THEN 'GBP' END AS currency,
  CAST(CASE WHEN k IN (1, 2, 4) THEN 0 WHEN k = 0 THEN 3 WHEN k = 6 THEN 6 END AS INTEGER) AS scale, CASE k WHEN 3 THEN 'unit_of_inputs' WHEN 5 THEN 'inputs_are_money' WHEN 7 THEN 'unknown_unit' END AS problem,
  'magnitude' AS sign_basis, CAST(sign(p / 2 - 1000) AS INTEGER) AS change_sign,
  md5('C1 = ' || format('{:,}', CAST(round_even(abs(-p / 2 + 1000), 0) AS BIGINT)) || '  (write it as: ' || format('{:,}', CAST(round_even(abs(-p / 2 + 1000), 0) AS BIGINT)) || ' [C1])  inputs: a = -' || rtrim(rtrim(format('{:,.2f}', p), '0'), '.') || ' from ''Total'' [D' || o_orderkey || ':p1:b1]') AS line FROM o""",
}

QUERIES = {f.__name__: f for f in (q22_calc_margin, q23_calc_growth, q24_calc_cagr, q25_calc_functions, q26_calc_pp, q27_calc_static_problems, q28_money_dim, q49_resolved_inputs, q50_guards, q55_result_units)}

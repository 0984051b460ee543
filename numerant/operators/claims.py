"""Statements made from the order tables: blocks that hold amounts, and answers that cite them, rightly or wrongly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerant.functions.numeric import shown, size_of, step_of

CASES = 8


def amount(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def order_blocks(orders: DataFrame) -> DataFrame:
    """One block per order with its total in dollars: block (id), block_no, pos and the value's columns."""
    value = amount("o_totalprice")
    out = orders.select(
        F.concat(F.lit("D"), F.col("o_orderkey"), F.lit(":p1:b1")).alias("block"), F.col("o_orderkey").alias("block_no"), F.lit(0).alias("pos"), F.abs(value).cast("decimal(24,6)").alias("value"), (value < 0).alias("neg"),
        F.lit(0).alias("scale"), F.lit(None).cast("string").alias("unit"), F.lit("USD").alias("currency"), F.lit(2).alias("decimals"), F.year("o_orderdate").alias("year"), F.array(F.year("o_orderdate")).alias("years"),
    )
    return out.withColumns({"size": size_of(F.col("value"), F.col("scale"), F.col("unit")), "step": step_of(F.col("decimals"), F.col("scale"), F.col("unit"))})


def order_claims(orders: DataFrame) -> DataFrame:
    """One figure per order: figure_id, case, block (cited, or null) and the figure's columns.

    Cases by key: 0 exact, 1 in thousands, 2 the thousands called millions, 3 negative, 4 in pounds, 5 as a percentage,
    6 citing a block that doesn't exist, 7 citing nothing.
    """
    case = F.col("o_orderkey") % CASES
    rounded = F.round(amount("o_totalprice") * F.lit("0.001").cast("decimal(4,3)"), 1)
    out = orders.select(
        F.col("o_orderkey").alias("figure_id"), case.cast("int").alias("case"),
        F.when(case == 6, F.concat(F.lit("D0:p1:b"), F.col("o_orderkey"))).when(case == 7, F.lit(None)).otherwise(F.concat(F.lit("D"), F.col("o_orderkey"), F.lit(":p1:b1"))).alias("block"),
        F.when(case.isin(1, 2), rounded.cast("decimal(24,6)")).otherwise(amount("o_totalprice").cast("decimal(24,6)")).alias("value"), (case == 3).alias("neg"),
        F.when(case == 1, 3).when(case == 2, 6).otherwise(0).alias("scale"), F.when(case == 5, "%").alias("unit"), F.when(case == 4, "GBP").when(case == 5, None).otherwise("USD").alias("currency"),
        F.when(case.isin(1, 2), 1).otherwise(2).alias("decimals"), F.year("o_orderdate").alias("year"),
    )
    return out.withColumns({"size": size_of(F.col("value"), F.col("scale"), F.col("unit")), "step": step_of(F.col("decimals"), F.col("scale"), F.col("unit"))})


def statements(claims: DataFrame) -> DataFrame:
    """The claims as text: figure_id, text."""
    sign = F.when(F.col("neg"), "-").otherwise("")
    symbol = F.when(F.col("currency") == "GBP", "£").when(F.col("currency") == "USD", "$").otherwise("")
    number = F.when(F.col("decimals") == 1, shown(F.col("value"), 1)).otherwise(shown(F.col("value"), 2))
    end = F.when(F.col("scale") == 3, "k").when(F.col("scale") == 6, "m").when(F.col("unit") == "%", "%").otherwise("")
    cite = F.coalesce(F.concat(F.lit(" ["), F.col("block"), F.lit("]")), F.lit(""))
    return claims.select("figure_id", F.concat(F.lit("The order totalled "), sign, symbol, number, end, cite, F.lit(".")).alias("text"))



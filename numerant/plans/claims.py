"""Queries over generated claims: extraction, matching, statuses, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerant.functions.numeric import close_enough, close_to_display, shown
from numerant.operators.blocks import block_values
from numerant.operators.checking import checked_figures
from numerant.operators.citations import expanded
from numerant.operators.claims import amount, order_blocks, order_claims, statements
from numerant.operators.evaluation import score_answers
from numerant.operators.figures import extract_figures
from numerant.operators.matching import cited_matches, currency_fits, in_year, near_misses, sign_fits, unit_fits, where_hints
from numerant.operators.report import verdicts
from numerant.operators.status import answer_decisions, figure_statuses, status_counts
from numerant.sources.tables import dealt, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "orders"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_claims(_orders(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_blocks(table(spark, sf_dir, "orders"))


def q09_extract_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from the rendered statements; the SQL computes it from the numbers they were rendered from."""
    found = extract_figures(statements(_claims(spark, sf_dir)), "figure_id")
    return found.select("figure_id", "pos", "value", "neg", "scale", "unit", "currency", "decimals", "size")


def q10_close_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir).join(_blocks(spark, sf_dir).select(F.col("block_no").alias("figure_id"), F.col("size").alias("target")), "figure_id")
    return c.select("figure_id", close_enough(F.col("size"), F.col("step"), F.col("target")).alias("close"))


def q11_close_to_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir).join(_blocks(spark, sf_dir).select(F.col("block_no").alias("figure_id"), F.col("size").alias("target")), "figure_id")
    return c.select("figure_id", close_to_display(F.col("size"), F.col("step"), F.col("target")).alias("close"))


def q12_match_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited_matches(_claims(spark, sf_dir), _blocks(spark, sf_dir), "block").select("figure_id", "case", "known", (F.col("hits") > 0).alias("hit"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).alias("f").join(_blocks(spark, sf_dir).alias("b"), F.col("f.block") == F.col("b.block"))


def q13_sign_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about customers' balances, which are negative for some, against the balances; a third drop the minus."""
    balance = F.col("c_acctbal").cast("decimal(18,2)")
    base = table(spark, sf_dir, "customer").select("c_custkey", F.struct(((balance < 0) & (F.col("c_custkey") % 3 > 0)).alias("neg")).alias("f"), F.struct((balance < 0).alias("neg")).alias("b"))
    flipped = base.withColumn("f", F.struct((F.col("f.neg") | (F.col("c_custkey") % 5 == 0)).alias("neg")))
    return flipped.select("c_custkey", F.col("f.neg").alias("stated"), F.col("b.neg").alias("shown"), sign_fits().alias("fits"))


def q14_currency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("f.figure_id", currency_fits().alias("fits"))


def q15_unit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("f.figure_id", unit_fits().alias("fits"))


def q16_year_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of totals per customer with a column per year; claims ask for a year that it may not have."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    columns = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_set("year")).alias("years"))
    asked = orders.withColumn("asked", F.when(F.col("o_orderkey") % 3 == 0, F.col("year") + 1).when(F.col("o_orderkey") % 3 == 1, F.col("year")))
    joined = asked.join(columns, "o_custkey").select("o_orderkey", F.struct(F.col("asked").alias("year")).alias("f"), F.struct("year", "years").alias("b"))
    return joined.select("o_orderkey", in_year().alias("fits"))


def q17_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_misses(_claims(spark, sf_dir), _blocks(spark, sf_dir), "block")
    return found.select("figure_id", F.array_join("kinds", ",").alias("kinds"), "near")


def q18_where_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all claims: the first three orders with a total that fits."""
    found = where_hints(_claims(spark, sf_dir), _blocks(spark, sf_dir))
    return found.select("figure_id", F.array_join(F.transform("found", lambda x: x.cast("string")), ",").alias("found"))


def q29_figure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figure_statuses(_claims(spark, sf_dir), _blocks(spark, sf_dir)).select("figure_id", "status")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: all claims about one customer's orders."""
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("figure_id"), F.col("o_custkey").alias("answer_id"))
    return figure_statuses(_claims(spark, sf_dir), _blocks(spark, sf_dir)).join(owner, "figure_id")


def q30_answer_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_decisions(_answers(spark, sf_dir), "answer_id")


def q31_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts(_answers(spark, sf_dir), "answer_id")


def q47_check_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions from text: all statements about a customer's orders, read and checked as one answer."""
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("figure_id"), F.col("o_custkey").alias("answer_id"))
    said = statements(_claims(spark, sf_dir)).join(owner, "figure_id")
    answers = said.groupBy("answer_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    return answer_decisions(checked_figures(answers, _blocks(spark, sf_dir)), "answer_id")


def _charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a charge of 1 % to 11 %, as written to two decimals and to one."""
    cents = F.pmod((amount("o_totalprice") * 100).cast("long"), F.lit(1000))
    charge = (cents / 100 + 1).cast("decimal(6,2)")
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("answer_id"), charge.alias("charge"), shown(charge, 2).alias("x"), shown(charge, 1).alias("y"))


def q53_block_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that say of a falling charge that it falls, rises or stands, exactly or rounded, near words of derived
    figures, or with the question's own number, or give a fee in another currency, scale, unit or sign, against blocks
    read from text."""
    rows = _charges(spark, sf_dir)
    cite = F.concat(F.lit(" [D"), F.col("answer_id"), F.lit(":p1:b1]."))
    said = [
        ("The charge fell by ", "x"), ("There was a charge of ", "x"), ("The charge went up, at ", "x"), ("The charge rose again ", "x"),
        ("The charge fell again ", "x"), ("The margin was ", "y"), ("The charge was ", "y"),
    ]
    text = F.concat(F.lit("I take the "), "x", F.lit("% as given."))
    for k, (words, number) in enumerate(said):
        text = F.when(F.col("answer_id") % 12 == k, F.concat(F.lit(words), number, F.lit("%"), cite)).otherwise(text)
    for k, (before, after) in enumerate([("£", "m"), ("$", "k"), ("", " kg"), ("-$", "m")], 8):
        text = F.when(F.col("answer_id") % 12 == k, F.concat(F.lit("The fee was " + before), "x", F.lit(after), cite)).otherwise(text)
    question = F.concat(F.lit("Is it "), F.when(F.col("answer_id") % 24 == 7, F.col("x")).otherwise("99.5"), F.lit("%?"))
    blocks = rows.select(F.concat(F.lit("D"), "answer_id", F.lit(":p1:b1")).alias("block"), F.concat(F.lit("The charge, after two years, fell again "), "x", F.lit("%. The fee was $"), "x", F.lit("m.")).alias("text"))
    return checked_figures(rows.select("answer_id", text.alias("text"), question.alias("question")), block_values(blocks), question="question").select("answer_id", "status", "why")


def q54_score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with working, brackets, asides and rounded figures, scored against keys."""
    rows = _charges(spark, sf_dir)
    k = F.col("answer_id") % 6
    exact, rounded = F.concat("x", F.lit("%")), F.concat("y", F.lit("%"))
    text = (
        F.when(k == 0, F.concat(F.lit("The charge is "), exact, F.lit(", as asked.")))
        .when(k == 1, F.concat(F.lit("The charge is "), rounded, F.lit(".")))
        .when(k == 2, F.concat(F.lit("Working: 2 * 3 / 4 = "), exact, F.lit("\nThis was asked."))).when(k == 3, F.concat(F.lit("The charge stands ("), exact, F.lit(") as asked.")))
        .when(k == 4, F.concat(F.lit("It is "), exact, F.lit(" and not 77.25%, as asked."))).otherwise(F.lit("Asked, but not found."))
    )
    answers = rows.select(F.col("answer_id").alias("qid"), text.alias("text"), F.when(F.col("answer_id") % 12 == 4, "Is it 77.25%?").otherwise("What is it?").alias("question"))
    keys = rows.select(F.col("answer_id").alias("qid"), F.array(exact).alias("expect"), F.array().cast("array<string>").alias("allow"), F.array(F.lit("asked")).alias("must_say"))
    return score_answers(answers, keys, question="question").select("qid", "correct", "missing", "wrong", "unsaid")


def q48_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(status_counts(_answers(spark, sf_dir), "answer_id"), "answer_id")


def q51_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about orders with placeholders for quotes, of which every other has none for the second."""
    orders = table(spark, sf_dir, "orders")
    answers = orders.select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("Total "), F.col("o_orderstatus"), F.lit(" [CITE_1], also [CITE_1, CITE_2] and [CITE_3].")).alias("text"))
    cite = F.concat(F.lit("D"), F.col("o_orderkey"), F.lit(":p1:c"))
    ids = orders.select(F.col("o_orderkey").alias("answer_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), cite.alias("c")).filter("n = 1 or answer_id % 2 = 0")
    return expanded(answers, ids.select("answer_id", F.concat(F.lit("CITE_"), "n").alias("placeholder"), F.concat("c", "n").alias("cite")))


def q52_year_pinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that put an order's total into its year, or every third into the one before, against its block."""
    orders = _orders(spark, sf_dir)
    year = F.year("o_orderdate") - F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    text = F.concat(F.lit("The total was $"), shown(amount("o_totalprice"), 2), F.lit(" in "), year, F.lit(" [D"), F.col("o_orderkey"), F.lit(":p1:b1]."))
    other = order_blocks(orders).withColumn("years", F.array(F.col("year"), F.col("year") - 1))
    return checked_figures(orders.select(F.col("o_orderkey").alias("answer_id"), text.alias("text")), other).select("answer_id", "status")


_CLAIMS = """
base AS (SELECT o_orderkey AS k, o_custkey AS cust, CAST(o_totalprice AS DECIMAL(18,2)) AS p, CAST(o_orderkey % 8 AS INTEGER) AS c FROM orders),
claims AS (SELECT k AS figure_id, cust, c, p,
  CASE WHEN c IN (1, 2) THEN CAST(round(p * CAST(0.001 AS DECIMAL(4,3)), 1) AS DECIMAL(24,6)) ELSE CAST(p AS DECIMAL(24,6)) END AS v,
  CASE WHEN c = 1 THEN 1000 WHEN c = 2 THEN 1000000 ELSE 1 END AS f,
  CASE WHEN c IN (1, 2) THEN 0.1 ELSE 0.01 END AS d FROM base),
sized AS (SELECT *, CAST(v AS DOUBLE) * f AS size, d * f / 2 AS half, abs(CAST(v AS DOUBLE) * f - CAST(p AS DOUBLE)) AS apart FROM claims),
near AS (SELECT *, round(apart, 4) = 0 OR (round(apart, 4) <= half AND round(apart, 4) <= 0.02 * CAST(p AS DOUBLE)) AS close FROM sized)
"""
_CHARGES = """
o AS (SELECT o_orderkey AS k, o_orderkey % 12 AS c12, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) % 1000 AS DECIMAL(18,2)) AS cents FROM orders),
n AS (SELECT *, CAST(cents * CAST(0.01 AS DECIMAL(3,2)) + 1 AS DECIMAL(18,2)) AS x FROM o),
m AS (SELECT *, CAST(round(x, 1) AS DECIMAL(18,2)) AS y FROM n),
r AS (SELECT *, abs(x - y) <= 0.05 AND abs(x - y) <= CAST(0.02 AS DECIMAL(3,2)) * x AS fits, abs(x - y) <= 0.05 AND abs(x - y) <= CAST(0.25 AS DECIMAL(3,2)) * x AS near FROM m)
"""
_STATUS = """CASE WHEN c = 7 THEN 'untraced' WHEN c = 6 THEN 'phantom' WHEN c IN (0, 1, 2) AND close THEN 'traced' ELSE 'mismatch' END"""

_Q30 = f"""WITH {_CLAIMS}, s AS (SELECT cust AS answer_id, {_STATUS} AS status FROM near)
 SELECT answer_id, count(*) AS figures, count(*) FILTER (WHERE status <> 'traced') AS problems, CASE WHEN bool_or(status <> 'traced') THEN 'deny' ELSE 'allow' END AS decision FROM s GROUP BY answer_id"""

SQL = {
    "q09_extract_figures": f"""WITH {_CLAIMS} SELECT figure_id, 0 AS pos, v AS value, c = 3 AS neg, CASE c WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 0 END AS scale, CASE WHEN c = 5 THEN '%' END AS unit,
 CASE WHEN c = 4 THEN 'GBP' WHEN c = 5 THEN NULL ELSE 'USD' END AS currency, CASE WHEN c IN (1, 2) THEN 1 ELSE 2 END AS decimals, CAST(v AS DECIMAL(24,6)) * CAST(f AS DECIMAL(7,0)) AS size FROM near""",
    "q10_close_enough": f"WITH {_CLAIMS} SELECT figure_id, close FROM near",
    "q11_close_to_display": f"WITH {_CLAIMS} SELECT figure_id, round(apart, 4) <= half AND round(apart, 4) <= 0.25 * CAST(p AS DOUBLE) AS close FROM near",
    "q12_match_block": f"WITH {_CLAIMS} SELECT figure_id, c AS case, c NOT IN (6, 7) AS known, c IN (0, 1, 2) AND close AS hit FROM near",
    "q13_sign_check": "SELECT c_custkey, (c_acctbal < 0 AND c_custkey % 3 > 0) OR c_custkey % 5 = 0 AS stated, c_acctbal < 0 AS shown, NOT ((c_acctbal < 0 AND c_custkey % 3 > 0) OR c_custkey % 5 = 0) OR c_acctbal < 0 AS fits FROM customer",
    "q14_currency_check": f"WITH {_CLAIMS} SELECT figure_id, c <> 4 AS fits FROM near WHERE c < 6",
    "q15_unit_check": f"WITH {_CLAIMS} SELECT figure_id, c <> 5 AS fits FROM near WHERE c < 6",
    "q16_year_column": """
WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) + 1 WHEN 1 THEN year(o_orderdate) END AS asked FROM orders),
c AS (SELECT DISTINCT o_custkey, y FROM o)
SELECT o_orderkey, asked IS NULL OR NOT EXISTS (SELECT 1 FROM c WHERE c.o_custkey = o.o_custkey AND c.y = o.asked) OR y = asked AS fits FROM o""",
    "q17_near_miss": f"""WITH {_CLAIMS} SELECT figure_id, CASE c WHEN 3 THEN 'sign' WHEN 4 THEN 'currency' WHEN 2 THEN 'scale' END AS kinds, CAST(p AS DECIMAL(24,6)) AS near FROM near
 WHERE c IN (3, 4) OR (c = 2 AND NOT close AND length(CAST(CAST(v * 10 AS BIGINT) AS VARCHAR)) >= 3
   AND abs(CAST(v AS DOUBLE) * 1000 - CAST(p AS DOUBLE)) <= least(50, 0.02 * CAST(p AS DOUBLE)) + 1e-6)""",
    "q18_where_hint": f"""WITH {_CLAIMS}, r AS (SELECT a.figure_id, b.figure_id AS other, row_number() OVER (PARTITION BY a.figure_id ORDER BY b.figure_id) AS r
  FROM near a JOIN near b ON CAST(b.p AS DOUBLE) BETWEEN a.size - a.half - 0.0001 AND a.size + a.half + 0.0001 AND round(abs(a.size - CAST(b.p AS DOUBLE)), 4) <= a.half AND round(abs(a.size - CAST(b.p AS DOUBLE)), 4) <= 0.02 * CAST(b.p AS DOUBLE)
  WHERE a.c NOT IN (3, 4, 5))
 SELECT figure_id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS found FROM r WHERE r <= 3 GROUP BY figure_id""",
    "q29_figure_status": f"WITH {_CLAIMS} SELECT figure_id, {_STATUS} AS status FROM near",
    "q30_answer_decision": _Q30,
    "q47_check_answers": _Q30,
    "q48_verdicts": f"""WITH {_CLAIMS}, s AS (SELECT cust AS answer_id, {_STATUS} = 'traced' AS good FROM near),
 n AS (SELECT answer_id, count(*) AS n, count(*) FILTER (WHERE good) AS t, count(*) FILTER (WHERE NOT good) AS u FROM s GROUP BY answer_id)
 SELECT answer_id, u = 0 AS ok, n || ' figures: ' || concat_ws(', ', CASE WHEN t > 0 THEN t || ' traced' END, CASE WHEN u > 0 THEN u || ' unsupported' END) AS verdict FROM n""",
    "q53_block_check": f"""WITH {_CHARGES}
 SELECT k AS answer_id, CASE c12 WHEN 0 THEN 'derived_needs_calc' WHEN 1 THEN 'traced' WHEN 2 THEN 'traced' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'traced' WHEN 5 THEN CASE WHEN y = x THEN 'traced' ELSE 'derived_needs_calc' END
   WHEN 6 THEN CASE WHEN fits THEN 'traced' ELSE 'mismatch' END WHEN 7 THEN CASE WHEN k % 24 = 7 THEN 'from_question' ELSE 'untraced' END ELSE 'mismatch' END AS status,
  CASE c12 WHEN 3 THEN 'opposite' WHEN 6 THEN CASE WHEN NOT fits THEN 'absent' END WHEN 8 THEN 'currency' WHEN 9 THEN 'scale' WHEN 10 THEN 'unit' WHEN 11 THEN 'sign' END AS why FROM r""",
    "q54_score_answers": f"""WITH {_CHARGES}, s AS (SELECT k AS qid, k % 6 AS c,
   CASE WHEN k % 6 = 1 THEN CASE WHEN near THEN 0 ELSE 1 END WHEN k % 6 = 5 THEN 1 WHEN k % 6 = 3 THEN 0 ELSE 0 END AS missing,
   CASE WHEN k % 6 = 1 THEN CASE WHEN near THEN 0 ELSE 1 END WHEN k % 6 = 4 AND k % 12 <> 4 THEN 1 ELSE 0 END AS wrong, CASE WHEN k % 6 = 1 THEN 1 ELSE 0 END AS unsaid FROM r)
 SELECT qid, missing + wrong + unsaid = 0 AS correct, CAST(missing AS BIGINT) AS missing, CAST(wrong AS BIGINT) AS wrong, CAST(unsaid AS BIGINT) AS unsaid FROM s""",
    "q51_placeholders": """SELECT o_orderkey AS answer_id, 'Total ' || o_orderstatus || ' [D' || o_orderkey || ':p1:c1], also [D' || o_orderkey || ':p1:c1]' || CASE WHEN o_orderkey % 2 = 0 THEN '[D' || o_orderkey || ':p1:c2]' ELSE '' END || ' and .' AS text FROM orders""",
    "q52_year_pinning": "SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 3 = 0 THEN 'mismatch' ELSE 'traced' END AS status FROM orders",
    "q31_status_counts": f"""WITH {_CLAIMS}, s AS (SELECT cust AS answer_id, {_STATUS} AS status FROM near)
 SELECT answer_id, count(*) FILTER (WHERE status = 'traced') AS traced, count(*) FILTER (WHERE status = 'calculated' OR status = 'calculated_with_assumption') AS calculated,
  count(*) FILTER (WHERE status = 'from_question') AS from_question, count(*) FILTER (WHERE status NOT IN ('traced', 'calculated', 'calculated_with_assumption', 'from_question')) AS unsupported FROM s GROUP BY answer_id""",
}

QUERIES = {f.__name__: f for f in (q09_extract_figures, q10_close_enough, q11_close_to_display, q12_match_block, q13_sign_check, q14_currency_check, q15_unit_check, q16_year_column, q17_near_miss, q18_where_hint, q29_figure_status, q30_answer_decision, q31_status_counts, q47_check_answers, q48_verdicts, q51_placeholders, q52_year_pinning, q53_block_check, q54_score_answers)}

"""What was found on larger tables and odd values."""

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from numerant.operators import evidence as V
from numerant.operators import figures, years
from numerant.operators.results import significant

SMALL = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_halves_are_those_of_doubles(spark):
    rows = spark.createDataFrame([(1.005,), (1.025,), (1.255,), (12.35,), (100.5,), (999.995,)], "v double")
    assert [r.s for r in rows.select(significant(F.col("v")).alias("s")).collect()] == ["1.00", "1.02", "1.25", "12.4", "101", "1,000"]


def test_parts_of_clauses_grow_with_the_table(spark):
    assert "REPARTITION_BY_NUM" in plan_of(spark, "q21_nearest_year")


def test_parts_of_sessions_grow_with_the_table(spark):
    assert "REPARTITION_BY_NUM" in plan_of(spark, "q61_drafts")


def test_what_is_read_from_texts_is_never_broadcast(spark):
    for name in ("q49_resolved_inputs", "q53_block_check", "q54_score_answers", "q63_block_values"):
        assert "Broadcast" not in plan_of(spark, name), name


def test_texts_of_blocks_are_read_once(spark):
    assert plan_of(spark, "q63_block_values").count("ArrowEvalPython") == 1


def test_figures_of_answers_are_dealt_out_once(spark):
    plan = plan_of(spark, "q47_check_answers")
    assert plan.count("Exchange hashpartitioning(_keep_clause_id") == 1 and "Exchange hashpartitioning(clause_id" not in plan and "Exchange hashpartitioning(_row" not in plan
    assert plan.count("Window [") <= 10  # 13 before


def test_figures_are_searched_only_where_digits_are():
    for text in ("(US$1,234.5m) and -£3.4bn-5 bn, CHF 7", "a1b22-(GBP 4)5% ٣ USD6 US$", "-(USD 12.50)(7)", "", "no digit"):
        masked = figures.blanked(text)
        want = [(m.start(), m.end()) for m in figures._FIGURE.finditer(masked)]
        assert [(x["start"], x["stop"]) for x in figures.cuts(pa.array([text])).to_pylist()[0]] == want, text


def test_years_are_searched_only_where_centuries_are():
    for text in ("In FY 2019: 5, from 2018 to 2020.", "FY19, 20 and 2021", "1920, 1.2019, 19-2020", "in 1996", "20 years"):
        plain = years._PERIOD.sub(lambda m: "\x00" * len(m[0]), text)
        want = [(int(m[1]), m.start(), m.end()) for m in years._YEAR.finditer(plain)]
        assert [(x["year"], x["y_start"], x["y_stop"]) for x in years._spots(pa.array([text])).to_pylist()[0]] == want, text


def test_chains_of_ranges_carry_what_was_said_first(spark):
    texts = spark.createDataFrame([(1, "Sales rose by $3-4-5m, then 7-8% and £1-2k")], "k int, text string")
    got = [(r.raw, r.currency, r.scale, r.unit, r.explicit_change, r.direction) for r in figures.extract_figures(texts, "k", exempt=False).orderBy("pos").collect()]
    rose = [("$3", "USD", 0, None, True, 1), ("4", "USD", 6, None, True, 1), ("5m", "USD", 6, None, True, 1)]
    assert got == [*rose, ("7", None, 0, "%", False, 0), ("8%", None, 0, "%", False, 0), ("£1", "GBP", 3, None, False, 0), ("2k", "GBP", 3, None, False, 0)]


def test_evidence_is_joined_in_the_parts_asked_for(spark):
    made = spark.createDataFrame([(n, f"C{n}") for n in range(20)], "figure_id int, cite string")
    inputs = spark.createDataFrame([(f"C{n}", k, s) for n in range(20) for k, s in ((1, "B1"), (2, V.ASSUMPTION), (3, f"C{n + 1}"))], "calc_id string, no int, source_id string")
    sources = spark.createDataFrame([("B1", "f", "p1")], "source_id string, file string, place string")
    found = V.evidence(made, inputs, parts=23)
    assert found.rdd.getNumPartitions() == 23
    assert sorted(map(str, found.collect())) == sorted(map(str, V.evidence(made, inputs).collect()))
    lines = {r.figure_id: r.line for r in V.evidence_lines(found, sources, parts=23).collect()}
    assert lines[19] == "f · p1; C20; 1 assumption" and lines[18] == "f · p1; C20; 2 assumptions"
    assert "REPARTITION_BY_NUM" in plan_of(spark, "q64_evidence_graph")

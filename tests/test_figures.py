"""The figure grammar: what is a figure, and what it says."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from numerant.functions.text import is_separator_row, normalised, printed_page, row_cells
from numerant.operators.figures import blanked, extract_figures

CASES = [
    # text, [(raw, value, neg, scale, unit, currency)]
    ("Revenue was £9,434m", [("£9,434m", "9434", False, 6, None, "GBP")]),
    ("sales of $1.2B and EUR12.5M", [("$1.2B", "1.2", False, 9, None, "USD"), ("EUR12.5M", "12.5", False, 6, None, "EUR")]),
    ("a fall of (27.9) %", [("(27.9) %", "27.9", True, 0, "%", None)]),
    ("820 kg (4.45%)", [("820 kg", "820", False, 0, "kg", None), ("4.45%", "4.45", False, 0, "%", None)]),
    ("rose 10-12%", [("10", "10", False, 0, "%", None), ("12%", "12", False, 0, "%", None)]),
    ("£9.2-9.4bn", [("£9.2", "9.2", False, 9, None, "GBP"), ("9.4bn", "9.4", False, 9, None, "GBP")]),
    ("(323) GBPm", [("(323) GBPm", "323", True, 6, None, "GBP")]),
    ("15 bps and 173.2 cents and 12.5x", [("15 bps", "15", False, 0, "bps", None), ("173.2 cents", "173.2", False, 0, "c", None), ("12.5x", "12.5", False, 0, "x", None)]),
    ("in 2024, FY2023, on 31 Dec 2024, page 140, Note 15, 4pm, COVID-19, Q3, 3D, 4K", []),
    ("7 people and 13 cats", [("13", "13", False, 0, None, None)]),
    ("5 points", [("5", "5", False, 0, None, None)]),
    ("reference 12345678 but 12,345,678", [("12,345,678", "12345678", False, 0, None, None)]),
    ("HS code 8471.30.00", []),
    ("2024 GBPm", []),
    ("report fy24_26.xlsx [D1:p1:b3]", []),
    (None, []),
    ("", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "id int, text string")
    out = {}
    for r in extract_figures(rows, "id").collect():
        out.setdefault(r.id, []).append(r)
    return out


@pytest.mark.parametrize("case", range(len(CASES)))
def test_figures_of_a_text(found, case):
    got = [(r.raw, Decimal(r.value), r.neg, r.scale, r.unit, r.currency) for r in sorted(found.get(case, []), key=lambda r: r.pos)]
    assert got == [(raw, Decimal(v), *rest) for raw, v, *rest in CASES[case][1]]


def test_documents_keep_years_and_small_numbers(spark):
    rows = spark.createDataFrame([(1, "2022 7 40ft")], "id int, text string")
    got = sorted((r.pos, r.raw, r.unparsed) for r in extract_figures(rows, "id", exempt=False).collect())
    assert got == [(0, "2022", False), (1, "7", False), (2, "40ft", True)]


@pytest.mark.parametrize(
    ("text", "direction", "explicit"),
    [("profit fell by 3%", -1, True), ("fell to 27.0%", 0, False), ("grew 5%", 1, True), ("a reduction of 19 GBPm", -1, True), ("lower at 29.6%", 0, False), ("margin 30%", 0, False), ("lower by 1.39%", -1, True)],
)
def test_direction(spark, text, direction, explicit):
    r = extract_figures(spark.createDataFrame([(1, text)], "id int, text string"), "id").first()
    assert (r.direction, r.explicit_change) == (direction, explicit)


def test_repeated_and_null_keys_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "13 cats", 5), (1, "13 cats", 6), (None, "£2m", 7)], "id int, text string, value int")
    got = sorted((r.id or 0, r.pos, r.raw) for r in extract_figures(rows, "id").collect())
    assert got == [(0, 0, "£2m"), (1, 0, "13"), (1, 0, "13")]
    assert extract_figures(rows.limit(0), "id").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="0123456789 .,-/()£$%kmbFY[]:DpCabx×\n", max_size=60))
def test_blanking_keeps_lengths(text):
    assert len(blanked(text)) == len(text)


def test_normalising_twice_changes_nothing(spark):
    texts = ["**5 points** \\$3 and 4\\%", "$2 \\times$ 3", "x^{1} ${ }^{2}$ m³ 5¹", "a  b\tc"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(normalised(F.col("text")).alias("a"))
    for r in rows.select("a", normalised(F.col("a")).alias("b")).collect():
        assert r.a == r.b


def test_table_rows(spark):
    lines = ["| a | b |", "|---|:--:|", "| | |", "a | b", "|--|x|", "140 Annual Report 2024 | x", "| Governance 57"]
    rows = spark.createDataFrame([(t,) for t in lines], "t string")
    got = [(r[0], r[1], r[2]) for r in rows.select(row_cells(F.col("t")), is_separator_row(F.col("t")), printed_page(F.col("t"))).collect()]
    assert [g[0] for g in got[:4]] == [["a", "b"], ["---", ":--:"], ["", ""], ["a", "b"]]
    assert [g[1] for g in got] == [False, True, False, False, False, False, False]
    assert [g[2] for g in got] == [None, None, None, None, None, 140, 57]

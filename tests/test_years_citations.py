"""Years that pin figures to columns; placeholders that become citations."""

from pyspark.sql import functions as F

from numerant.operators.blocks import block_values
from numerant.operators.checking import checked_figures, scopes
from numerant.operators.citations import expanded, quote_ids
from numerant.operators.years import clause_year, single_year

TABLE = "| | 2022 GBPm | 2023 GBPm |\n|---|---|---|\n| Revenue | 8,553 | 9,161 |"


def test_years_of_texts(spark):
    texts = ["Sales in 2023 rose", "from 2022 to 2023", "2022 and 2021, then 2020", "sales (2023: £5m) in 2024", "sales 2024 against 2023", "no year", "£2,023.5 in FY2024", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(single_year(F.col("t")).alias("s"), clause_year(F.col("t")).alias("c")).collect()
    assert [(r.s, r.c) for r in rows] == [(2023, 2023), (None, None), (2020, 2020), (None, 2024), (None, None), (None, None), (2024, 2024), (None, None), (None, None)]


def test_figures_fit_their_years(spark):
    values = block_values(spark.createDataFrame([("D1:p1:b1", TABLE)], "block string, text string"))
    said = {
        1: "Revenue was £9,161m in 2023 [D1:p1:b1].", 2: "Revenue was £9,161m in 2022 [D1:p1:b1].", 3: "In 2022, revenue was £8,553m [D1:p1:b1] and £9,161m [D1:p1:b1] in 2023.",
        4: "2022: £9,161m [D1:p1:b1]", 5: "It grew from 2022 to 2023, to £9,161m [D1:p1:b1].", 6: "In 2019 it was £9,161m [D1:p1:b1].", 7: "In 2022 the whole of the group's reported revenue came to £9,161m [D1:p1:b1].",
        8: "| Item | 2022 |\n|---|---|\n| Revenue | £9,161m [D1:p1:b1] |", 9: "| Item | 2023 |\n|---|---|\n| Revenue | £9,161m [D1:p1:b1] |", 10: "| Item | GBP |\n|---|---|\n| Revenue 2022 | £9,161m [D1:p1:b1] |",
    }
    answers = spark.createDataFrame(list(said.items()), "answer_id int, text string")
    got = {}
    for r in checked_figures(answers, values).collect():
        got.setdefault(r.answer_id, set()).add(r.status)
    bad, good = {"mismatch"}, {"traced"}
    assert got == {1: good, 2: bad, 3: good, 4: bad, 5: good, 6: good, 7: bad, 8: bad, 9: good, 10: bad}
    assert checked_figures(answers.limit(0), values).count() == 0
    third = scopes(answers.filter("answer_id = 3")).orderBy("segment_id").collect()
    assert [(r.clause[r.offset : r.offset + len(r.text)] == r.text, r.clause_id) for r in third] == [(True, "3.0.0")] * 3


def test_placeholders(spark):
    answers = spark.createDataFrame([(1, "a [CITE_1] b [CITE_2, CITE_3].[CITE_9] c [x]"), (2, None), (3, "[CITE_1]"), (4, "")], "answer_id int, text string")
    ids = spark.createDataFrame([(1, "CITE_1", "D1:p1:c1"), (1, "CITE_2", None), (1, "CITE_3", "D1:p2:c2"), (1, "CITE_3", "D1:p2:c2"), (None, None, None)], "answer_id int, placeholder string, cite string")
    assert {r.answer_id: r.text for r in expanded(answers, ids).collect()} == {1: "a [D1:p1:c1] b [D1:p2:c2]. c [x]", 2: None, 3: "", 4: ""}
    found = spark.createDataFrame([(1, 0, "B2", 3), (1, 1, "B1", 0), (1, 2, "B2", 3), (2, 0, "B1", 0)], "a int, pos int, block string, line int")
    assert sorted((r.a, r.pos, r.quote_no) for r in quote_ids(found, "a", "pos", "block", "line").collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 1), (2, 0, 1)]

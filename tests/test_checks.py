"""Checks of figures against blocks, questions and calculations; scores of answers; what is said of them."""

import pytest
from pyspark.sql import functions as F

from numerant.operators import denials as D
from numerant.operators import evaluation as E
from numerant.operators.blocks import block_values
from numerant.operators.checking import checked_figures, empty_citations
from numerant.operators.figures import extract_figures
from numerant.operators.turns import answers_with_figures, since, valid_calculations


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [("D1:p1:b1", "Sales were 3.0% and costs 34.15%"), ("D1:p1:b2", "Profit fell sharply 3.0% to £19m"), ("D1:p1:b3", "| Item | 2024 £m | 2023 £m |\n|---|---|---|\n| Revenue | 9,434 | 9,161 |\n| Loss | (12) | 7 |")]
    return block_values(spark.createDataFrame(rows, "block string, text string"))


CASES = [
    ("Sales fell sharply 3.0% [D1:p1:b1].", "mismatch", "opposite"), ("The operating margin 34.2% [D1:p1:b1].", "derived_needs_calc", None), ("The operating margin 34.15% [D1:p1:b1].", "traced", None),
    ("Costs of 34.2% [D1:p1:b1].", "traced", None), ("Profit fell sharply 3.0% [D1:p1:b2].", "traced", None), ("Profit rose sharply 3.0% [D1:p1:b2].", "mismatch", "opposite"),
    ("Profit fell by 3.0% [D1:p1:b2].", "derived_needs_calc", None), ("Is 12.5% enough?", "from_question", None), ("It is 12.6%.", "untraced", None), ("Revenue was £9,434m in 2023 [D1:p1:b3].", "mismatch", "year"),
    ("Revenue was £9,434m in 2024 [D1:p1:b3].", "traced", None), ("Revenue was £77m [D1:p1:b3].", "mismatch", "absent"), ("Revenue was £9,434m [D9:p1:b1].", "phantom", None), ("It took 40qq [D1:p1:b1].", "unparsed", None),
    ("| x | Margin |\n|---|---|\n| a | 34.2% [D1:p1:b1] |", "derived_needs_calc", None), ("A loss of -£12m [D1:p1:b3].", "traced", None), ("A gain of -£7m [D1:p1:b3].", "mismatch", "sign"),
    ("Revenue was $9,434m [D1:p1:b3].", "mismatch", "currency"), ("Revenue was £9,434k [D1:p1:b3].", "mismatch", "scale"), ("Revenue was 9,434 kg [D1:p1:b3].", "mismatch", "unit"),
    ("Revenue was £9.434 [D1:p1:b3].", "mismatch", "scale"), ("Revenue was -$9,434k in 2024 [D1:p1:b3].", "mismatch", "currency+sign+scale"), ("Revenue was $9,161m in 2024 [D1:p1:b3].", "mismatch", "currency"),
    ("Revenue was $9,161m in 2019 [D1:p1:b3].", "mismatch", "currency"), ("Sales were £3.0m [D1:p1:b1].", "mismatch", "absent"),
]


def test_block_checks(spark, blocks):
    answers = spark.createDataFrame([(k, t, "Was it 12.5%?") for k, (t, *_) in enumerate(CASES)] + [(90, None, None), (91, "", "x")], "answer_id int, text string, question string")
    got = {r.answer_id: (r.status, r.why) for r in checked_figures(answers, blocks, question="question").collect()}
    assert got == {k: (s, w) for k, (_, s, w) in enumerate(CASES)}


def test_only_this_turns_calculations_count(spark, blocks):
    calcs = spark.createDataFrame([("C1", 0.0298, True, None, None, 0, 1, False), ("C2", 0.05, True, None, None, 0, 1, True)], "calc_id string, result double, is_percent boolean, unit string, currency string, scale int, change_sign int, has_assumption boolean")
    answers = spark.createDataFrame([(1, "It grew 2.98% [C1] and 5.0% [C2]."), (2, "It grew 2.98% [C1]."), (3, "It fell 2.98% [C1].")], "answer_id int, text string")
    valid = spark.createDataFrame([(1, "C1"), (1, "C2"), (3, "C1")], "answer_id int, calc_id string")
    rows = checked_figures(answers, blocks, calcs, valid=valid).collect()
    assert sorted((r.answer_id, r.raw.strip(), r.status) for r in rows) == [(1, "2.98%", "calculated"), (1, "5.0%", "calculated_with_assumption"), (2, "2.98%", "phantom"), (3, "2.98%", "mismatch")]


def test_chains_of_ranges(spark):
    rows = spark.createDataFrame([(1, "from £9.2-9.4-9.6bn and 10-12% or rose 3-5-7%")], "k int, text string")
    got = [(str(r.value.normalize()), r.currency, r.scale, r.unit, r.explicit_change, r.direction) for r in extract_figures(rows, "k").orderBy("pos").collect()]
    assert got == [("9.2", "GBP", 0, None, False, 0), ("9.4", "GBP", 9, None, False, 0), ("9.6", "GBP", 9, None, False, 0), ("1E+1", None, 0, "%", False, 0), ("12", None, 0, "%", False, 0), ("3", None, 0, None, True, 1), ("5", None, 0, "%", True, 1), ("7", None, 0, "%", True, 1)]


def test_asides_and_exempt_values(spark):
    rows = spark.createDataFrame([(1, "820 kg (4.45%) (5) (6.5)"), (2, "(4.45%) and 77 and 78")], "k int, text string")
    got = [(r.k, r.raw, r.neg) for r in extract_figures(rows, "k", exempt_values=(77,)).orderBy("k", "pos").collect()]
    # After the bracketed 5, which as an aside is a small number and none of the figures, 6.5 is no aside.
    assert got == [(1, "820 kg", False), (1, "4.45%", False), (1, "(6.5)", True), (2, "(4.45%)", True), (2, "78", False)]


KEYS = [(1, ["£20,269m"], ["7%"], ["rounded"]), (2, ["-£19m"], None, None), (3, ["12 kg"], [], []), (4, ["3.4%"], [], None)]


def test_scores(spark, blocks):
    keys = spark.createDataFrame(KEYS, "qid int, expect array<string>, allow array<string>, must_say array<string>")
    answers = spark.createDataFrame([
        (1, "It is £20.3bn, Rounded, and 7%.", "?"), (2, "A loss (£19m).", "?"), (3, "2 * 6 / 1 = 12 kg\nSo it is 45 kg.", "Is it 45 kg?"), (4, "Costs 34.15% and growth 99%.", "?"), (9, "No key 5%.", "?"),
    ], "qid int, text string, question string")
    held = blocks.filter("block = 'D1:p1:b1'").withColumn("qid", F.lit(4))
    got = {r.qid: (r.correct, r.missing, r.wrong, r.unsaid, r.bad_key) for r in E.score_answers(answers, keys, question="question", blocks=held).collect()}
    assert got == {1: (True, 0, 0, 0, False), 2: (True, 0, 0, 0, False), 3: (True, 0, 0, 0, False), 4: (False, 1, 1, 0, False), 9: (None, None, None, None, False)}
    bad = spark.createDataFrame([(1, ["one", "1,000 and 2,000"], None, None)], "qid int, expect array<string>, allow array<string>, must_say array<string>")
    assert E.score_answers(answers, bad).first().bad_key
    assert E.score_answers(answers.limit(0), keys).count() == 0


def test_drafts_and_what_was_caught(spark):
    rows = [(1, 0, "user", "q0", False), (1, 1, "assistant", "old", False), (1, 2, "user", "q", False), (1, 3, "assistant", "d1", False), (1, 4, "user", "denied", True), (1, 5, "user", "denied again", True), (1, 6, "assistant", " ", False), (1, 7, "assistant", "d2", False), (1, 8, "user", "denied", True), (1, 9, "assistant", "final", False)]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, injected boolean")
    assert sorted((r.turn, r.draft) for r in E.drafts(messages).collect()) == [(4, "d1"), (5, None), (8, "d2")]
    wrong = spark.createDataFrame([(1, "5%"), (1, "6%"), (1, "5%")], "q int, raw string")
    assert [tuple(r) for r in E.caught(wrong, spark.createDataFrame([(1, "6%")], "q int, raw string"), "q").collect()] == [(1, "5%")]


def test_answers_and_calculations_of_a_turn(spark):
    rows = [(1, 0, "user", "q", False), (1, 1, "tool", "C1 = 5%  (write it as: 5% [C1])  inputs: a", False), (1, 2, "assistant", "It is 5% [C1].", False), (1, 3, "assistant", "Anything else?", False), (2, 0, "user", "q", False), (2, 1, "tool", "C7 = 1 (write it as: 1 [C7])", False), (2, 2, "user", "again", False), (2, 3, "assistant", "Hello.", False)]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, injected boolean")
    assert {r.conv_id: r.answer for r in answers_with_figures(messages).collect()} == {1: "It is 5% [C1].\nAnything else?", 2: "Hello."}
    assert [tuple(r) for r in valid_calculations(messages).collect()] == [(1, "C1")]
    checks = spark.createDataFrame([(1, 1, "deny", 1), (1, 2, "allow", 1), (2, 1, "allow", 1)], "s int, at int, decision string, before int")
    assert [(r.s, r.new, r.decision) for r in since(checks, "s", ["at"], "before").collect()] == [(1, 1, "allow")]


def test_decisions_and_messages(spark, blocks):
    texts = [(1, "q1", 1, "Sales fell sharply 3.0% [D1:p1:b1]. See [D1:p1:b2]."), (2, "q1", 2, "I can't say."), (3, "q2", 1, "Costs 34.15% [D1:p1:b1]."), (4, "q3", 1, "Hello."), (5, "q4", 1, "x"), (6, "q5", 1, "x"), (7, "q5", 2, "Costs 34.15%."), (8, "q5", 3, "Hm."), (9, "q5", 4, "It is 1.2%.")]
    answers = spark.createDataFrame([(k, q, n, t, "cancelled" if k in (5, 6, 8) else None, k != 4, True) for k, q, n, t in texts], "answer_id int, question string, n int, text string, reason string, has_ledger boolean, has_documents boolean")
    figures = checked_figures(answers, blocks)
    told = D.figure_problems(figures).select("answer_id", F.col("figure_id").alias("place"), "problem", F.lit(False).alias("empty"))
    empty = D.empty_problems(empty_citations(answers), blocks, "answer_id").select("answer_id", F.col("scope_id").alias("place"), "problem", F.lit(True).alias("empty"))
    got = {r.answer_id: r for r in D.decisions(answers, figures, told.unionByName(empty), "answer_id", ["n"]).collect()}
    assert [got[k].decision for k in range(1, 6)] == ["deny", "allow", "allow", "allow", "not_checked"]
    assert got[1].message.startswith("Attempt 1 of 4. Untraced figures (1 of 1), citations without a figure: 1:\n1. '3.0%' has the opposite sign or direction to D1:p1:b1\n2. citation [D1:p1:b2] has no figure next to it. Put the figure next to its citation, for example 3.0% [D1:p1:b2]\n")
    assert got[2].attempt == 2 and "earlier draft was denied" in got[2].message
    assert got[3].message == "traceable: 1 figures traced" and got[4].message is None and got[5].message == "NOT CHECKED: cancelled"
    # What was not checked is no attempt.
    assert [got[k].attempt for k in (6, 7, 8, 9)] == [None, 1, None, 2] and got[9].message.startswith("Attempt 2 of 4")
    counts = {r.question: (r.checks, r.denials) for r in D.denials(spark.createDataFrame(list(got.values())), "question").collect()}
    assert counts["q1"] == (2, 1) and counts["q2"] == (1, 0)
    ids = spark.range(1).select(D.question_id(F.lit("s"), F.lit(2), F.lit("q")).alias("a"), D.question_id(F.lit("s"), F.lit(3), F.lit("q")).alias("b")).first()
    assert ids.a != ids.b and len(ids.a) == 12


def test_hints_for_the_first_figures_and_words_for_near_misses(spark):
    rows = [(1, f"1.0.0.{n}#0", f"{n}.5", "D1:p1:b1", "mismatch", "absent", n == 3) for n in range(1, 12)] + [(1, "1.1.0.0#0", "7", "D1:p1:b2", "mismatch", "currency+scale", False)]
    figures = spark.createDataFrame(rows, "answer_id int, figure_id string, raw string, cite string, status string, why string, computable boolean")
    hints = figures.select("figure_id", F.array(F.lit("D9:p1:b1")).alias("found"))
    got = {r.figure_id: r.problem for r in D.figure_problems(figures, hints).collect()}
    assert [n for n in range(1, 12) if "it appears in D9:p1:b1" in got[f"1.0.0.{n}#0"]] == [1, 2, 3, 4, 5]
    assert got["1.0.0.3#0"].endswith(D.COMPUTED) and not got["1.0.0.2#0"].endswith(D.COMPUTED)
    assert got["1.1.0.0#0"] == "'7' has another currency than D1:p1:b2, and has another scale than D1:p1:b2"

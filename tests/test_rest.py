"""Blocks, sources, calculations, retrieval, stores, transcripts, evaluation, streams, queries."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from numerant.functions.text import domain, html_paragraphs
from numerant.operators import ledger, turns
from numerant.operators.blocks import block_values
from numerant.functions.numeric import size_of, step_of
from numerant.operators.results import power
from numerant.operators.calculation import tree, compiled, displayed, evaluated, problems
from numerant.operators.evaluation import arm_matrix, arm_summary, missing_and_wrong
from numerant.operators.matching import cited_matches
from numerant.operators.retrieval import lines_of, page_holding, top_passages, verified_quotes
from numerant.sources import ocr
from numerant.streaming.attempts import counted_attempts
from numerant.streaming.windows import deduplicated, tumbling_totals

RELX = "| | Note | 2022 GBPm | 2023 GBPm |\n|---|---|---|---|\n| Revenue | 2 | 8,553 | 9,161 |\n| Finance costs | 7 | (205) | (323) |\n| Basic EPS | 9 | 85.2p | 94.1p |"
DIAGEO = "| | Notes | 2024 $ million |\n|---|---|---|\n| Net sales | 2 | 20,269 |\n| | | million |\n| Shares | | 2,234 |\n| | | cents |\n| EPS | 8 | 173.2 |"


@pytest.fixture(scope="module")
def values(spark):
    rows = [("A", RELX, None), ("B", DIAGEO, None), ("C", "| | Q3 FY24 |\n|---|---|\n| Users | 698,479 |\n| Gross Value ($M) | 1,200 |", "(in thousands)"), ("D", "Revenue rose to £9,434m.", None), ("E", None, None), ("F", "", None)]
    return block_values(spark.createDataFrame(rows, "block string, text string, caption string")).cache()


def test_block_values(values):
    got = {(r.block, r.raw): (r.label, r.year, r.neg, r.unit, r.scale, r.currency) for r in values.collect()}
    assert got == {
        ("A", "8,553"): ("Revenue", 2022, False, None, 6, "GBP"), ("A", "9,161"): ("Revenue", 2023, False, None, 6, "GBP"), ("A", "(205)"): ("Finance costs", 2022, True, None, 6, "GBP"),
        ("A", "(323)"): ("Finance costs", 2023, True, None, 6, "GBP"), ("A", "85.2p"): ("Basic EPS", 2022, False, "p", 0, None), ("A", "94.1p"): ("Basic EPS", 2023, False, "p", 0, None),
        ("B", "20,269"): ("Net sales", 2024, False, None, 6, "USD"), ("B", "2,234"): ("Shares", 2024, False, None, 6, ""), ("B", "173.2"): ("EPS", 2024, False, "c", 0, None),
        ("C", "698,479"): ("Users", None, False, None, 3, "USD"), ("C", "1,200"): ("Gross Value ($M)", None, False, None, 6, "USD"), ("D", "£9,434m"): ("Revenue rose to", None, False, None, 6, "GBP"),
    }


def test_answers_against_blocks(spark, values):
    from numerant.operators.figures import extract_figures

    said = [(0, "A", "£8,553m"), (1, "A", "£8.6bn"), (2, "A", "$8,553m"), (3, "A", "£205m"), (4, "A", "85.2p"), (5, "B", "$20.3bn"), (6, "B", "$173.2m"), (7, "B", "2,234 million"), (8, "C", "698,479k"), (9, "C", "$698.5m"), (10, "C", "698,479m")]
    texts = spark.createDataFrame(said, "figure_id int, block string, text string")
    figures = extract_figures(texts, "figure_id").join(texts.select("figure_id", "block"), "figure_id")
    got = {r.figure_id: r.hits > 0 for r in cited_matches(figures, values, "block").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: True, 8: True, 9: True, 10: False}


def test_ocr_blocks(spark, tmp_path):
    block = {"top_left_x": 1, "top_left_y": 2, "bottom_right_x": 3, "bottom_right_y": 4}
    doc = {"doc_id": "D1", "model": "m", "pages": [{"index": 0, "dimensions": {"dpi": 1, "height": 9, "width": 8}, "blocks": [block | {"content": "Head", "type": "header"}, block | {"content": "Title", "type": "title"}, block | {"content": "a **5**\nb", "type": "text"}]}, {"index": 1, "blocks": []}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    rows = ocr.ocr_blocks(ocr.ocr_responses(spark, str(tmp_path)))
    assert [(r.block_id, r.type, r.text, r.bbox, r.width) for r in rows.orderBy("n").collect()] == [("D1:p1:b1", "header", "Head", [1, 2, 3, 4], 8), ("D1:p1:b2", "title", "Title", [1, 2, 3, 4], 8), ("D1:p1:b3", "text", "a 5\nb", [1, 2, 3, 4], 8)]
    assert [r.line for r in ocr.listing(rows).orderBy("block_id", "line_no").collect()] == ["(heading) Title", "[D1:p1:b3] a 5", "[D1:p1:b3] b"]


def test_conversations(spark, tmp_path):
    results = [{"text": json.dumps({"0": {"url": "http://a", "title": "A", "description": "<b>x</b>", "snippets": ["<i>s</i> 5"]}})}, {"text": json.dumps({"description": "card <b>d</b>", "content": {"card_data": {"title": "GDP", "series": [{"points": [{"x": "2023", "y": 1234.5}, {"x": "2024", "y": None}]}]}}})}, {"text": "no json"}]
    outputs = [{"type": "tool.execution", "result": results}, {"type": "message.output", "content": [{"type": "text", "text": "It is "}, {"type": "tool_reference", "url": "http://a", "title": "other"}, {"type": "tool_reference", "url": "http://b", "title": "B"}, {"type": "text", "text": "5."}]}]
    (tmp_path / "c.json").write_text(json.dumps({"conv_id": "1", "outputs": outputs}))
    rows = spark.read.schema(ocr.CONVERSATION).json(str(tmp_path))
    got = {r.key: (r.title, r.description, r.snippets) for r in ocr.conversation_sources(rows).collect()}
    assert got == {"http://a": ("A", "x", ["s 5"]), "card:GDP": ("GDP", "card d", ["card d", "2023: 1,234"]), "http://b": ("B", "", [])}
    assert ocr.conversation_answers(rows).first().answer == "It is 5."


def test_pages(spark):
    html = "<html><head><title>The title of the page is long</title><script>var x = 'a long script text here';</script></head><body><nav>navigation text long enough</nav><p>First paragraph has 5 figures &amp; more</p><div>short</div><li>Second   paragraph\nwith a break in it</li></body>"
    rows = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    assert [r[0] for r in rows.select(html_paragraphs(F.col("h"))).collect()] == [["First paragraph has 5 figures & more", "Second paragraph with a break in it"], [], []]
    urls = spark.createDataFrame([("https://WWW.a.com/x",), ("ftp://b",), (None,), ("x",)], "u string")
    assert [r[0] for r in urls.select(domain(F.col("u"))).collect()] == ["a.com", "b", "", ""]


@pytest.mark.parametrize(
    ("formula", "env", "want"),
    [
        ("(a - b) / a", (8.0, 2.0), 0.75), ("a / (b - 2)", (8.0, 2.0), None), ("a ** (1 / b)", (9.0, 2.0), 3.0), ("a ** 2 - -b", (3.0, 1.0), 10.0), ("min(a, b, 1)", (3.0, 2.0), 1.0), ("max(a, b)", (3.0, 2.0), 3.0),
        ("round(a)", (2.5, 0.0), 2.0), ("round(a / b, 2)", (1.0, 8.0), 0.12), ("abs(a - b)", (1.0, 3.0), 2.0), ("(0 - a) ** 0.5 + b", (4.0, 1.0), None), ("a - b - 1", (5.0, 1.0), 3.0), ("b ** -1", (0.0, 0.0), None),
    ],
)
def test_formulas(spark, formula, env, want):
    got = spark.createDataFrame([env], "a double, b double").select(compiled(formula).alias("r")).first().r
    assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-12)


@pytest.mark.parametrize("formula", ["a +", "a.b", "__import__('os')", "a b", "lambda: a", "a[0]", "1 if a else 2", "", "a)", "pow(a, 2)", "a; b", "`a`"])
def test_not_formulas(formula):
    assert "syntax" in problems(formula, ["a"], ["a"])
    with pytest.raises(ValueError):
        compiled(formula)


def test_problems_and_catalogue(spark):
    assert problems("a / b", ["a", "b"], ["a"]) == [] and problems("a * 100", ["a"], ["a"]) == ["literal"] and problems("a + " * 200 + "a", ["a"], ["a"]) == ["too_long"]
    assert problems("a + a", ["a", "a"], ["a"]) == ["duplicate_name"]
    rows = spark.createDataFrame([("m", 4.0, 1.0), ("g", 4.0, 1.0), ("?", 4.0, 1.0), ("m", None, 1.0)], "formula string, a double, b double")
    assert [r.result for r in evaluated(rows, {"m": "a - b", "g": "a / b"}).collect()] == [3.0, 4.0, None, None]
    assert [power(tree(f), {"a": 1}) for f in ("a / 2", "a / a", "a + 1", "a * a", "a + b", "round(a, 2)", "-a")] == [1, 0, None, 2, None, 1, 1]


def test_display(spark):
    rows = spark.createDataFrame([(0.30326,), (0.0502,), (-0.00216,), (1.5,), (0.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(displayed(F.col("v"), "pct")).collect()] == ["30.3%", "5.02%", "-0.216%", "150.0%", "0.0%", None]
    rows = spark.createDataFrame([(1234567.6,), (0.30326,), (2.1,)], "v double")
    assert [r[0] for r in rows.select(displayed(F.col("v"))).collect()] == ["1,234,568", "0.303", "2.10"]
    assert rows.select(displayed(F.col("v"), "money", "£", "m")).first()[0] == "£1,234,567.60m"


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "Revenue of the group was 9,434 in 2024\nNo numbers here\nCosts were 5"), (2, "revenue 1"), (3, None)], "doc_id int, text string")
    lines = lines_of(docs, "doc_id")
    asked = spark.createDataFrame([(7, "What was the revenue of the group?")], "q int, text string")
    assert [(r.doc_id, r.line, r.score, r["rank"]) for r in top_passages(asked, lines, "q", "doc_id").orderBy("rank").collect()] == [(1, 0, 9, 1), (2, 0, 3, 2)]
    quotes = spark.createDataFrame([(1, "revenue group 2024: 9,434"), (2, "revenue group 9,435"), (3, "costs were high in all respects"), (4, None)], "q int, text string")
    assert [(r.q, r.doc_id, r.line, r.score) for r in verified_quotes(quotes, lines, "q", "doc_id").collect()] == [(1, 1, 0, 1.0)]
    held = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (2, 11)], "p int, page int")
    assert sorted((r.p, r.page, r.n_rows) for r in page_holding(held, "p", "page").collect()) == [(1, 10, 2), (2, None, 1)]


def test_ledger(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, t string")
    assert sorted(map(tuple, ledger.upserted(rows, "k", [F.col("v")]).collect())) == [("a", 2, "y"), ("b", 1, "z")]
    assert [tuple(r) for r in ledger.missing(rows, spark.createDataFrame([("a",)], "k string"), ["k"]).collect()] == [("b", 1, "z")]
    assert [r.n for r in ledger.numbered(rows, "k", [F.col("v")], "n").orderBy("k", "v").collect()] == [1, 2, 1]
    page = spark.createDataFrame([(1, 1, "title", "(in thousands)"), (1, 2, "text", "plain"), (1, 3, "table", "t"), (1, 4, "table", "u"), (1, 5, "text", "(in millions)"), (1, 6, "table", "v")], "p int, n int, type string, text string")
    got = ledger.captions(page, "p", [F.col("n")], F.col("type") == "table", F.col("text").contains("in "), F.col("text")).filter("type = 'table'").orderBy("n")
    assert [r.caption for r in got.collect()] == ["(in thousands)", None, "(in millions)"]


def test_turns(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "assistant", " "), (2, 0, "assistant", "x"), (3, 0, "user", "q")]
    got = turns.selected_answers(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, "q2", 3, "a2"), (3, 0, "q", None, None)]
    figures = spark.createDataFrame([(1, 0, 10, 14), (1, 1, 30, 34), (1, 2, 80, 84)], "c int, pos int, start int, stop int")
    years = spark.createDataFrame([(1, 2023, 16, 20), (1, 2024, 36, 40), (1, 2022, 55, 59)], "c int, year int, y_start int, y_stop int")
    assert sorted((r.pos, r.year) for r in turns.year_hints(figures, years, "c").collect()) == [(0, 2023), (1, 2024), (2, None)]


def test_evaluation(spark):
    kind = "q int, value double, scale int, unit string, currency string, neg boolean"

    def sized(rows):
        df = spark.createDataFrame(rows, kind).withColumn("value", F.col("value").cast("decimal(24,6)"))
        return df.withColumns({"size": size_of(F.col("value"), F.col("scale"), F.col("unit")), "step": step_of(F.lit(0), F.col("scale"), F.col("unit"))})

    stated = sized([(1, 5.0, 6, None, "GBP", False), (1, 7.0, 0, None, None, False), (2, 1.0, 0, "%", None, False)])
    expected = sized([(1, 5.0, 6, None, "GBP", False), (2, 2.0, 0, "%", None, False), (3, 1.0, 0, None, None, False)])
    assert sorted(map(tuple, missing_and_wrong(stated, expected, "q").collect())) == [(1, 0, 1), (2, 1, 1), (3, 1, 0)]
    runs = spark.createDataFrame([("full", 1, 2.0, True), ("full", 1, 4.0, False), ("read", 2, 1.0, True)], "arm string, qid int, seconds double, correct boolean")
    assert sorted(map(tuple, arm_summary(runs).collect())) == [("full", 2, 1, 3.0, 4.0, 1), ("read", 1, 1, 1.0, 1.0, 1)]
    assert sorted(map(tuple, arm_matrix(runs, ["full", "read"]).collect())) == [(1, "1/2", None), (2, None, "1/1")]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(k, f"2024-01-01 00:{k:02d}:00", k % 2, "view", 1.0) for k in range(30)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))

    def run(df, mode, name):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(once=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert query.awaitTermination(100)
        return spark.table(name)

    got = run(tumbling_totals(stream, "10 minutes"), "complete", "t1")
    want = tumbling_totals(events, "10 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    assert run(deduplicated(stream, ["user_id"]), "append", "t2").count() == deduplicated(events, ["user_id"]).count() == 2
    checks = stream.select(F.col("user_id").cast("string").alias("question"), F.col("event_id").alias("check_id"), F.lit("deny").alias("decision"))
    tried = run(counted_attempts(checks), "append", "t3").filter("question = '0'").orderBy("attempt").collect()
    assert [(r.check_id, r.attempt, r.final) for r in tried[:5]] == [(0, 1, False), (2, 2, False), (4, 3, False), (6, 4, True), (8, 5, True)]


def test_every_query_has_a_name_and_sql():
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known)
    assert {n for n in known if n.startswith("q")} <= set(sql)


def test_matrix_has_every_question(spark, tmp_path):
    rows = [(39, "view", 25.0), (40, "view", 25.0), (40, "view", 5.0), (1499, "click", 5.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = __spark_entry__.queries()["q36_arm_question_matrix"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(39, None, None, "1/1"), (40, None, None, "1/2"), (1499, "0/1", None, None)]


def test_checked_answers(spark, values):
    from numerant.operators.checking import checked_figures, clauses, empty_citations, prepared, scopes

    calcs = spark.createDataFrame(
        [("C1", 0.3033, True, None, None, None, None, False), ("C2", -19e6, False, None, "GBP", 6, None, False), ("C3", 820.0, False, "kg", None, None, None, True)],
        "calc_id string, result double, is_percent boolean, unit string, currency string, scale int, change_sign int, has_assumption boolean",
    )
    said = [
        (1, "Revenue was £8,553m [A]. Costs were £205m [A]; the margin was 30.3% [C1].", []),
        (2, "It fell by £19m. [C2]", []), (3, "It rose by £19m [C2] and weighs 820 kg [C3].", []), (4, "Costs vs. plan were £5m and £6m [C9].", []),
        (5, "| Item | Value |\n|---|---|\n| Weight | 820 kg [C3] |\n| Other | 13 |", []), (6, None, []), (7, "Nothing here [C1].", []), (8, "Revenue increased by £19m [D1:p1:b1].", []),
    ]
    answers = spark.createDataFrame([(k, t.replace("[A]", "[D1:p1:b1]") if t else t) for k, t, _ in said], "answer_id int, text string")
    held = values.filter("block = 'A'").withColumn("block", F.lit("D1:p1:b1"))
    got = {}
    for r in checked_figures(answers, held, calcs).collect():
        got.setdefault(r.answer_id, []).append((r.raw, r.status))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [("30.3%", "calculated"), ("£205m", "traced"), ("£8,553m", "traced")], 2: [("£19m", "calculated")], 3: [("820 kg", "calculated_with_assumption"), ("£19m", "mismatch")],
        4: [("£5m", "phantom"), ("£6m", "phantom")], 5: [("13", "untraced"), ("820 kg", "calculated_with_assumption")], 8: [("£19m", "derived_needs_calc")],
    }
    assert [(r.answer_id, r.cites) for r in empty_citations(answers).collect()] == [(7, ["C1"])]
    line = spark.createDataFrame([("Sales vs. plan rose [C1; C2]; costs fell. 13. x e.g. that! Done",)], "t string")
    assert line.select(clauses(prepared(F.col("t")))).first()[0] == ["Sales vs. plan rose [C1; C2]; ", "costs fell. ", "13. ", "x e.g. that! ", "Done"]
    assert scopes(answers.limit(0)).count() == 0


def test_report(spark):
    from numerant.operators.report import markdown, verdicts, views

    counts = spark.createDataFrame([(1, 2, 1, 0, 0), (2, 0, 0, 0, 3), (3, 0, 0, 0, 0), (4, None, None, None, None)], "a int, traced int, calculated int, from_question int, unsupported int")
    assert {r.a: (r.ok, r.verdict) for r in verdicts(counts, "a").collect()} == {1: (True, "3 figures: 2 traced, 1 calculated"), 2: (False, "3 figures: 3 unsupported"), 3: (True, "no figures"), 4: (False, "NOT CHECKED")}
    checks = spark.createDataFrame([("q1", 1, "allow"), ("q1", 2, "not_checked"), ("q2", 3, "not_checked"), ("q3", 0, "deny"), ("q3", 4, "allow")], "q string, at int, decision string")
    assert [(r.view, r.q, r.at) for r in views(checks, "q", "at").orderBy("view").collect()] == [(1, "q3", 4), (2, "q2", 3), (3, "q1", 1)]
    assert markdown(counts.limit(1), ["a", "traced"]).first().line == "| 1 | 2 |"

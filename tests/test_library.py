"""Passages of libraries, pages and quotes; transcripts and requests; the store; units of results."""

import pytest
from pyspark.sql import functions as F

from numerant.operators import ledger as L
from numerant.operators import library as B
from numerant.operators import results as R
from numerant.sources import transcripts as T


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


TABLE = "| Item | 2024 £m |\n|---|---|\n| Revenue | 9,434 |\n| Profit | 2,861 |"


def test_library_passages(spark):
    questions = spark.createDataFrame([(1, "What was the revenue?", "Revenue was large, profit too")], "qid int, text string, answer string")
    refs = spark.createDataFrame([(10, 1, "Report", "A summary 5"), (11, 1, "Accounts 2024", None), (12, 1, "the notes", None), (13, 1, "Accounts 2024 again", None), (14, 1, "unknown", None)], "ref_id int, qid int, title string, summary string")
    chunks = spark.createDataFrame([(10, 0, "140 Annual Report 2024 | x\nrevenue of 7 apples"), (10, 1, "A summary 5"), (10, 2, f"The revenue\n{TABLE}\n142"), (10, 3, "nothing here")], "ref_id int, chunk int, text string")
    documents = spark.createDataFrame([("a", 0, "Accounts 2024"), ("n", 1, "Notes")], "doc_id string, pos int, name string")
    pages = spark.createDataFrame([("a", 1, "Contents 1"), ("a", 2, f"in millions\nText\n{TABLE}"), ("Report", 5, "| Revenue | 9,434 |\n| Profit | 2,861 |"), ("Report", 6, "| Profit | 2,861 |")], "doc_id string, page int, text string")
    texts = spark.createDataFrame([("n", "140 Annual Report 2024 | x\nGBPm\nRevenue was 12\nOther 13\n141 Annual Report 2024 | x\nfar 14"), ("a", "never read 1 revenue")], "doc_id string, text string")
    got = rows_of(B.library_passages(refs, chunks, documents, pages, texts, questions), "ref_id", "chunk", "strategy", "page", "text")
    assert got == [
        (10, 0, "chunk", 140, "revenue of 7 apples"), (10, 2, "chunk", 5, "| Item | 2024 £m |\n|---|---|\n| Revenue | 9,434 |\n| Profit | 2,861 |"),
        (11, None, "pages", 2, "| Item | 2024 £m |\n|---|---|\n| Revenue | 9,434 |\n| Profit | 2,861 |"), (12, None, "text", 140, "GBPm\nRevenue was 12"),
    ]
    none = refs.limit(0)
    assert B.library_passages(none, chunks, documents, pages, texts, questions).count() == 0


def test_passages_of_one_table_page_or_text(spark):
    """As a plain loop would choose them: one table of one page, or the lines of one page, or those of a text."""
    questions = spark.createDataFrame([(1, "revenue profit", "")], "qid int, text string, answer string")
    refs = spark.createDataFrame([(k, 1, t, None) for k, t in enumerate(["tables", "lines", "plain"])], "ref_id int, qid int, title string, summary string")
    documents = spark.createDataFrame([("t", 0, "tables"), ("l", 1, "lines"), ("p", 2, "plain")], "doc_id string, pos int, name string")
    chunks = spark.createDataFrame([], "ref_id int, chunk int, text string")
    tables = "in millions\nRevenue and profit 1 stand below\n| a | 2024 |\n|---|---|\n| revenue | 5 |\n| cost | 4 |\nthen\n| b | 2023 |\n|---|---|\n| profit | 6 |"
    pages = spark.createDataFrame([
        ("t", 1, "| revenue of | 2022 |\n|---|---|\n| profit | 3 |"), ("t", 2, tables), ("l", 1, "GBPm\nrevenue was 3"), ("l", 2, "£m\nrevenue and profit were 7\nand 8\nprofit 9"),
    ], "doc_id string, page int, text string")
    texts = spark.createDataFrame([("p", "140 Annual Report 2024 | x\nGBPm\nRevenue was 12\nin millions\nOther\nprofit 13\n| revenue | 5 |\n141 Annual Report 2024 | x")], "doc_id string, text string")
    got = {r.ref_id: (r.page, r.text) for r in B.library_passages(refs, chunks, documents, pages, texts, questions).collect()}
    assert got == {
        0: (1, "|---|---|\n| revenue of | 2022 |\n| profit | 3 |"), 1: (1, "GBPm\nrevenue was 3"), 2: (140, "in millions\nRevenue was 12\nprofit 13\n| revenue | 5 |"),
    }


def test_documents_by_names_that_hold_each_other(spark):
    names = ["Accounts 2024", "accounts", "", "é", "Ab", "report of the accounts 2024 in full", "zz"]
    titles = ["ACCOUNTS 2024", "the accounts", "a", "", None, "x é y", "full", "ab initio", "report", "q"]
    for skipped in ((), ("",)):
        docs = [(f"d{k}", k, n) for k, n in enumerate(names) if n not in skipped]
        found = B.matched_documents(spark.createDataFrame(list(enumerate(titles)), "ref_id int, title string"), spark.createDataFrame(docs, "doc_id string, pos int, name string"))
        want = {}
        for r, t in enumerate(titles):
            low = (t or "").lower()
            d = next((d for d, _, n in docs if n.lower() in low or low in n.lower()), None)
            want |= {r: d} if d else {}
        assert {r.ref_id: r.doc_id for r in found.collect()} == want


def test_best_lines_fall_back_and_keep_order(spark):
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["two 2", "apples 3", "Apples 3", "no number", "red apples 4"])], "d int, line int, text string")
    asked = spark.createDataFrame([(1, "red apples")], "d int, text string")
    assert rows_of(B.best_lines(asked, lines, "d", ["d"], 2), "line", "score") == [(1, 3), (4, 6)]
    assert rows_of(B.best_lines(asked.withColumn("text", F.lit("zebra")), lines, "d", ["d"], 2), "line") == [(0,), (1,)]
    ranked = B.best_chunks(spark.createDataFrame([(1, 1, 0, "red"), (1, 1, 1, "red apples"), (1, 1, 2, "apples")], "d int, doc int, chunk int, text string"), asked, "d", "doc")
    assert rows_of(ranked, "chunk") == [(1,), (2,)]  # of equals the later


def test_web_passages(spark):
    sources = spark.createDataFrame([(1, 1, "u1", "a", None), (2, 1, None, "card", ["Rate:  5 ", " "]), (3, 1, "u3", "none", None), (4, 1, None, "no", [])], "source_id int, qid int, url string, title string, snippets array<string>")
    pages = spark.createDataFrame([("u1", "<p>The revenue was 12 million in all.</p><p>Nothing of interest stands here</p>"), ("u3", "<p>no figures on this page at all</p>")], "url string, html string")
    asked = spark.createDataFrame([(1, "revenue rate", "")], "qid int, text string, answer string")
    assert rows_of(B.web_passages(sources, pages, asked), "source_id", "text") == [(1, "The revenue was 12 million in all."), (2, "Rate: 5")]


def test_asked_document(spark):
    table = "| Item | 2024 $m |\n|---|---|\n| Revenue | 9 |\n| | cents |\n| EPS | 173.2 |"
    lines = spark.createDataFrame([("D1:p1:b1", k, t) for k, t in enumerate(table.split("\n"))], "block string, line int, text string")
    found = spark.createDataFrame([(1, 1, "D1:p1:b1", 4, 1), (1, 2, "D1:p1:b1", 2, 1), (1, 3, "D1:p1:b1", 4, 1)], "answer_id int, pos int, block string, line int, page int")
    text, blocks = B.asked_document(spark.createDataFrame([(1, "EPS 173.2 [CITE_1], revenue 9 [CITE_2] . Again [CITE_3].")], "answer_id int, text string"), found, lines)
    assert text.first().text == "EPS 173.2 [D1:p1:c1], revenue 9 [D1:p1:c2]. Again [D1:p1:c1]."
    assert rows_of(blocks, "block_id", "text") == [("D1:p1:c1", "| Item | 2024 $m |\n|---|---|\n| | cents |\n| EPS | 173.2 |"), ("D1:p1:c2", "| Item | 2024 $m |\n|---|---|\n| Revenue | 9 |")]


def test_transcripts_and_requests(spark):
    lines = [
        ("a", 0, '{"role": "user", "content": "q \\"x\\""}'), ("a", 1, '{"role": "assistant", "content": [{"type": "text", "text": "one"}, "two", {"type": "image"}]}'), ("a", 2, "[1, 2]"), ("a", 3, ""),
        ("a", 4, '{"role": "user", "injected": true, "content": {"text": "denied"}}'), ("a", 5, '{"role": "tool"}'), ("b", 0, '{"role": "user"'),
    ]
    messages, broken = T.transcripts(spark.createDataFrame(lines, "session string, pos int, line string"))
    assert rows_of(messages, "pos", "role", "text", "injected") == [(0, "user", 'q "x"', False), (1, "assistant", "one\ntwo", False), (4, "user", "denied", True), (5, "tool", "", False)]
    assert rows_of(broken, "session") == [("b",)]
    asked = spark.createDataFrame([(1, '{"cwd": "/w", "transcript_path": "/t.jsonl", "session_id": "s"}'), (2, "nonsense"), (3, "[]"), (4, '{"cwd": "/w"}'), (5, None)], "k int, request string")
    assert rows_of(T.requests(asked), "k", "cwd", "problem") == [(1, "/w", None), (2, None, T.BAD_INPUT), (3, None, T.BAD_INPUT), (4, "/w", T.NO_TRANSCRIPT), (5, None, T.BAD_INPUT)]
    runs = spark.createDataFrame([(1, "/w//x/"), (2, "/y")], "run int, dir string")
    sessions = spark.createDataFrame([("/w/x", 1, "old"), ("/w/x/", 2, "new"), (None, 3, "none")], "cwd string, started int, session string")
    assert rows_of(T.runs_with_sessions(runs, sessions), "run", "session") == [(1, "new"), (2, None)]


def test_store(spark, tmp_path):
    asked = spark.createDataFrame([(1, "/a.pdf", [1, 2, 2], 5), (2, "a.pdf", None, 5), (3, "/a.txt", None, 5), (4, "/a.pdf", None, 31), (5, "/a.PDF", [6], 5), (6, "/a.pdf", list(range(1, 32)), 99), (7, "/b.pdf", None, None), (8, "/a.pdf", None, 30)], "k int, path string, pages array<int>, n_pages int")
    assert [r.problem for r in L.read_problems(asked).orderBy("k").collect()] == [None, "relative_path", "no_document", "too_many_pages", "out_of_range", "too_many_pages", "no_document", None]
    blocks = spark.createDataFrame([("D1", 0, "D1:p1:b1", "x"), ("W", None, "W2", "y")], "doc_id string, page_index int, block_id string, text string")
    wanted = spark.createDataFrame([("D1", [1, 3], 9), ("D2", None, 2)], "doc_id string, pages array<int>, n_pages int")
    assert rows_of(L.pages_to_read(wanted, blocks), "doc_id", "page") == [("D1", 3), ("D2", 1), ("D2", 2)]
    more = L.with_sources(blocks, spark.createDataFrame([("b", "two"), ("a", "one")], "title string, text string").drop("title").withColumn("doc_id", F.lit("W")), "W", [F.col("text")])
    assert rows_of(more.filter("text in ('one', 'two')"), "block_id", "text") == [("W3", "one"), ("W4", "two")]
    assert rows_of(L.saved(more, str(tmp_path / "t")), "block_id") == rows_of(more, "block_id")


@pytest.mark.parametrize(("kind", "unit", "want"), [("pct", "%", (None, None, None)), ("pct", "pp", ("pp", None, None)), ("pct", "kg", (None, None, "not_with_pct")), ("num", "percent", (None, None, "needs_pct")), ("num", "Pence", ("p", None, None)), ("num", "£m", (None, ("GBP", 6), None)), ("num", "USD", (None, ("USD", None), None)), ("num", "bn", (None, (None, 9), None)), ("num", "?", (None, None, "unknown_unit")), ("num", " ", (None, None, None))])
def test_units_asked_for(spark, kind, unit, want):
    r = spark.range(1).select(R.resolved_unit(F.lit(kind), F.lit(unit)).alias("u")).first().u
    assert (r.unit, r.money and tuple(r.money), r.problem) == want


def test_ways_to_write_a_value(spark):
    rows = spark.createDataFrame([("20269", 0, "USD", 6, None), ("173.2", 1, None, 0, "c"), ("5", 0, None, 6, None), ("1234.5", 1, "CHF", 0, None)], "v string, d int, c string, s int, u string").withColumn("v", F.col("v").cast("decimal(24,6)"))
    got = rows.select(R.rewrites(F.col("v"), F.col("d"), F.col("c"), F.col("s")).alias("w"), R.stated_as(F.col("u"), F.col("c"), F.col("s")).alias("t")).collect()
    assert [(r.w, r.t) for r in got] == [(["$20,269m", "$20.3bn"], "$ million"), (["173.2"], "cents"), (["5m"], "millions"), (["CHF 1,234.5", "CHF 1.23k"], "CHF")]

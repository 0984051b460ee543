"""Versions of tables, checks as a stream, evidence over levels, exact formulas."""

import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from numerant.operators import calculation as C
from numerant.operators import evidence as V
from numerant.operators import exact as X
from numerant.operators import ledger as L
from numerant.operators import retrieval as R
from numerant.operators.turns import attempts, selected_answers
from numerant.sources import versions as S
from numerant.streaming import live


def rows(spark, low, high):
    return spark.range(low, high).withColumn("text", F.concat(F.lit("t"), "id"))


def test_a_write_that_is_killed_leaves_the_old_version(spark):
    path = S.fresh_folder(spark, "v")
    assert S.current(spark, path) is None
    S.replaced(rows(spark, 0, 3), path, [F.col("id")])
    S.written(rows(spark, 0, 100), path)  # killed before its commit
    assert sorted(r.id for r in S.current(spark, path).collect()) == [0, 1, 2]
    local = path.removeprefix("file://")
    with open(f"{local}/{S.COMMITS}/{2:012d}", "w") as f:  # killed within its commit
        f.write('{"parts": [{"name"')
    assert sorted(r.id for r in S.current(spark, path).collect()) == [0, 1, 2]
    S.appended(rows(spark, 3, 5), path, [F.col("id")])
    assert sorted((r.number, r.id) for r in S.current(spark, path).collect()) == [(k + 1, k) for k in range(5)]
    assert sorted(os.listdir(f"{local}/{S.COMMITS}"))[-1].startswith("000000000003")


def test_two_writers_get_different_ids(spark, monkeypatch):
    path = S.fresh_folder(spark, "v")
    S.appended(rows(spark, 0, 4), path, [F.col("id")])
    real, beaten = S.newest, []

    def late(spark, path):  # another writer commits between this one's look and its own commit
        found = real(spark, path)
        if not beaten:
            beaten.append(1)
            S.appended(rows(spark, 10, 13), path, [F.col("id")])
        return found

    monkeypatch.setattr(S, "newest", late)
    S.appended(rows(spark, 20, 22), path, [F.col("id")])
    monkeypatch.undo()
    got = sorted((r.number, r.id) for r in S.current(spark, path).collect())
    assert got == list(zip(range(1, 10), [0, 1, 2, 3, 10, 11, 12, 20, 21], strict=True))
    ids = S.with_ids(S.current(spark, path), "W", "block_id")
    assert {r.block_id for r in ids.collect()} == {f"W{k}" for k in range(1, 10)}


def test_numbers_over_many_ranges_and_empty_parts(spark):
    path = S.fresh_folder(spark, "v")
    S.appended(rows(spark, 0, 0), path, [F.col("id")])
    assert S.current(spark, path).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    S.appended(rows(spark, 0, 1000).repartition(5), path, [F.col("id").desc()])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r.number, r.id) for r in S.current(spark, path).collect())
    assert got == [(k + 1, 999 - k) for k in range(1000)]


CHECKS = [("q1", 1, "deny"), ("q1", 2, "not_checked"), ("q2", 3, "allow"), ("q1", 4, "deny"), ("q1", 5, "allow"), ("q2", 6, "not_checked"), ("q1", 7, "deny"), ("q3", 8, "allow"), ("q1", 9, "allow")]


def test_a_stream_of_checks_equals_the_batch(spark, tmp_path):
    spark.conf.set(*live.STATE_STORE)
    source, store, state = tmp_path / "in", "file://" + str(tmp_path / "store"), str(tmp_path / "state")
    source.mkdir()

    def arrive(name, part):
        (source / name).write_text("".join(json.dumps(dict(zip(("question", "check_id", "decision"), c, strict=True))) + "\n" for c in part))
        stream = spark.readStream.schema("question string, check_id long, decision string").json(str(source))
        query = live.into_store(live.live_attempts(stream), store, state)  # each time from the checkpoint
        assert query.awaitTermination(100)

    arrive("a.json", CHECKS[:4])
    arrive("b.json", CHECKS[4:])
    got = sorted((r.question, r.check_id, r.attempt, r.denied_before, r.final) for r in S.current(spark, store).collect())
    table = spark.createDataFrame(CHECKS, "question string, check_id long, decision string")
    want = {(r.question, r.check_id): r.attempt for r in attempts(table.filter("decision <> 'not_checked'"), "question", ["check_id"]).collect()}
    assert [(q, c, a) for q, c, a, _, _ in got] == sorted(((q, c, want.get((q, c))) for q, c, _ in CHECKS), key=lambda r: r[:2])
    assert [(c, b) for q, c, _, b, _ in got if q == "q1"] == [(1, False), (2, True), (4, True), (5, True), (7, True), (9, True)]
    assert [c for *_, c in got if c] == [True, True]
    n = S.current(spark, store).count()
    S.appended(table, store, batch=0)  # a batch that ran before adds nothing
    assert S.current(spark, store).count() == n == len(CHECKS)


def test_answers_after_a_denial(spark):
    said = [(1, 0, "user", "q", False), (1, 1, "assistant", "draft", False), (1, 2, "user", "denied", True), (2, 0, "user", "q", False), (2, 1, "assistant", "d", False), (2, 2, "user", "no", True), (2, 3, "assistant", "final", False)]
    messages = spark.createDataFrame(said, "conv_id int, turn int, role string, text string, injected boolean")
    assert {r.conv_id: (r.question, r.answer) for r in selected_answers(messages).collect()} == {1: ("q", None), 2: ("q", "final")}


def test_evidence_over_levels_and_cycles(spark):
    inputs = spark.createDataFrame(
        [("C1", 1, "D1:p1:b1"), ("C1", 2, "C2"), ("C1", 3, "assumption"), ("C2", 1, "D1:p2:b1"), ("C2", 2, "C1"), ("C2", 3, "D2:p1:b1"), ("C2", 4, "assumption"), ("C3", 1, "C3"), ("C3", 2, "W1"), ("C3", 3, "D1:p1:b1")],
        "calc_id string, no int, source_id string",
    )
    sources = spark.createDataFrame([("D1:p1:b1", "a.pdf", "page 1"), ("D1:p2:b1", "a.pdf", "page 2"), ("D2:p1:b1", "b.pdf", None)], "source_id string, file string, place string")
    figures = spark.createDataFrame([(1, "C1"), (2, "D1:p1:b1"), (3, "C3"), (4, None), (5, "D9:p9:b9")], "figure_id int, cite string")
    found = V.evidence(figures, inputs)
    assert sorted((r.node, r.level, r.at) for r in found.filter("figure_id = 1").collect()) == [("C1", 0, []), ("C2", 1, [2]), ("D1:p1:b1", 1, [1]), ("D1:p2:b1", 2, [2, 1]), ("D2:p1:b1", 2, [2, 3]), ("assumption", 1, [3]), ("assumption", 2, [2, 4])]
    lines = {r.figure_id: r.line for r in V.evidence_lines(found, sources).collect()}
    assert lines == {1: "a.pdf · page 1, page 2; b.pdf; 2 assumptions", 2: "a.pdf · page 1", 3: "W1; a.pdf · page 1", 5: "D9:p9:b9"}
    assert V.evidence(figures.limit(0), inputs).count() == 0


CASES = [
    ("a + b", "1.1", "2.2", "3.3", False, None), ("a / b", "1", "3", "0." + "3" * 28, False, None), ("a / b", "1", "0", None, False, "division_by_zero"), ("a ** b", "0", "0", None, False, "zero_power"),
    ("a ** b", "0", "-1", None, False, "zero_power"), ("a ** b", "2", "101", None, False, "large_exponent"), ("a ** b", "-4", "0.5", None, False, "negative_base"), ("a ** b", "4", "0.5", "2.0", True, None),
    ("a ** b", "1.1", "2", "1.21", False, None), ("((a ** 100) ** 100) ** b", "99", "100", None, False, "overflow"), ("a + c", "1", "2", None, False, "unknown_name"), ("a +", "1", "2", None, False, "syntax"),
    ("round(a, b)", "2.345", "2", "2.34", False, None), ("round(a, b)", "2.345", "0.5", None, False, "places"), ("max(a, b) - min(a, b)", "5", "7.25", "2.25", False, None), ("-abs(a) * b", "-3", "2", "-6", False, None), (None, "1", "2", None, False, None),
]


def test_exact_formulas(spark):
    table = spark.createDataFrame([(k, f, {"a": Decimal(a), "b": Decimal(b)}) for k, (f, a, b, *_) in enumerate(CASES)] + [(99, "a", None), (98, "a", {"a": None})], "k int, f string, inputs map<string, decimal(24,6)>")
    got = {r.k: (r.x.result, r.x.used_float, r.x.code) for r in table.select("k", X.exactly(F.col("f"), F.col("inputs")).alias("x")).collect()}
    for k, (_, _, _, result, used, code) in enumerate(CASES):
        assert (got[k][0] is None) == (result is None) and got[k][1:] == (used, code)
        assert result is None or Decimal(got[k][0]) == Decimal(result)
    assert got[99][2] == got[98][2] == "unknown_name"
    with pytest.raises(ValueError):
        X.tree("a +")


def test_names_that_hold_each_other(spark):
    cases = [
        (1, "Operating profit FY2024 / Operating profit + x", ["Operating profit", "Operating profit FY2024", "x"], "operating_profit_fy2024 / operating_profit + x", 2),
        (2, "a b + a-b + a.b", ["a b", "a-b", "a.b"], "a_b + a_b_2 + a_b_3", 3), (3, "2024 sales - %", ["2024 sales", "%"], "x_2024_sales - x_", 2), (4, "x + y", ["x", "y"], "x + y", 0), (5, "x", [], "x", 0),
    ]
    table = spark.createDataFrame([c[:3] for c in cases], "k int, f string, names array<string>")
    text, pairs = C.renamed(F.col("f"), F.col("names"))
    assert {r.k: (r.t, r.n) for r in table.select("k", text.alias("t"), F.size(pairs).alias("n")).collect()} == {c[0]: c[3:] for c in cases}


def test_figures_that_are_there(spark):
    values = spark.createDataFrame([("B1", f" {k % 40} ") for k in range(200)] + [("B2", None), ("B3", "7"), ("B3", "7 ")], "block string, raw string")
    got = {r.block: r.figures for r in R.figures_there(values).collect()}
    assert got == {"B1": ", ".join(sorted(map(str, range(40)))[:15]), "B3": "7"}


def test_cached_pages_fall_back_to_the_whole_file(spark):
    entries = spark.createDataFrame([("a", "m", 1, "a1"), ("a", "m", None, "all of a"), ("b", "m", 2, "b2"), ("b", "m", 2, "b1"), ("a", "n", None, "other"), (None, "m", 1, "none")], "sha string, model string, pages int, text string")
    asked = spark.createDataFrame([("a", "m", 1), ("a", "m", 2), ("a", "m", None), ("b", "m", 2), ("b", "m", 3), ("b", "m", None), ("c", "m", 1), (None, "m", 1), ("a", "m", 1)], "sha string, model string, pages int")
    got = {(r.sha, r.pages): (r.level, r.text) for r in L.cached(asked, entries, ["sha", "model"]).collect()}
    assert got == {
        ("a", 1): ("pages", "a1"), ("a", 2): ("file", "all of a"), ("a", None): ("file", "all of a"), ("b", 2): ("pages", "b1"), ("b", 3): (None, None), ("b", None): (None, None), ("c", 1): (None, None), (None, 1): (None, None),
    }
    assert L.cached(asked, entries.limit(0), ["sha", "model"]).filter("level is null").count() == 8

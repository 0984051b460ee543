"""What was found on larger tables in round 4."""

import random

import pyarrow as pa

import __spark_entry__
from numerant.operators import evidence as V
from numerant.operators import figures
from numerant.operators.blocks import block_values

SMALL = "/root/testdata/sf0.001"
TABLES = "| In | 2023 £m | 2024 |\n| | | £bn |\n|---|---|---|\n| Sales (bn) | 5 | 1,234 |\n| | $k | pence |\n| Costs | (7) | 8 |\nIn all 9.\n| Rest | 3 | 4 |"


def plan_of(spark, name):
    return __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_figures_meet_the_lines_of_their_block_in_one_join(spark):
    assert plan_of(spark, "q63_block_values").count("SortMergeJoin") == 1


def test_lines_headers_and_unit_rows_of_a_block(spark):
    rows = block_values(spark.createDataFrame([("a", TABLES), ("b", None), ("c", "| 5 |\n|---|")], "block string, text string")).collect()
    got = sorted((r.pos, r.label, r.col, r.year, r.years, int(r.value), r.neg, r.unit, r.scale, r.currency) for r in rows)
    assert got == [
        (2, "Sales (bn)", 1, 2023, [2023, 2024], 5, False, None, 9, ""), (3, "Sales (bn)", 2, 2024, [2023, 2024], 1234, False, None, 9, ""),
        (4, "Costs", 1, 2023, [2023, 2024], 7, True, None, 3, "USD"), (5, "Costs", 2, 2024, [2023, 2024], 8, False, "p", 0, None),
        (6, "In all", None, None, [2023, 2024], 9, False, None, 6, "GBP"), (7, "Rest", 1, 2023, [2023, 2024], 3, False, None, 6, "GBP"), (8, "Rest", 2, 2024, [2023, 2024], 4, False, None, 6, "GBP"),
    ]


def test_patterns_that_cannot_match_are_not_searched():
    text = "| Item | 1998 £m | 1997 £m | Note |\n|---|---|---|\n| Total | 345,123.67 | (345,123.67) | 4 |"
    searched = [p.pattern for held, beside, p in figures._BLANKED if any(h in text.lower() for h in held) and beside.search(text)]
    assert [p[:11] for p in searched] == [r"(?i)\((?:FY", r"(?m)^\s*\d+"]  # eight before
    assert figures.blanked("2001-03-04 1998/99 2024E p. 4 Note7 a-1 7-day 3rd\n 2) 5").split() == ["5"]
    assert [c["number"] for c in figures.cuts(pa.array(["NOK 5 GBP\n7 -(£8)"])).to_pylist()[0]] == ["5", "7", "8"]


def walked(figures_, inputs):
    """What the figures rest on, one step after the other."""
    calcs, out = {c for c, _, _ in inputs if c is not None}, []

    def step(figure, way, at):
        node = way[-1]
        goes_on = node in calcs and node != V.ASSUMPTION
        out.append((figure, node, len(at), at, way[-2] if len(way) > 1 else None, not goes_on))
        for calc, no, source in inputs if goes_on else ():
            if calc == node and source is not None and source not in way:
                step(figure, [*way, source], [*at, no])

    for figure, cite in figures_:
        if cite is not None:
            step(figure, [cite], [])
    return sorted(map(str, out))


def test_shared_calculations_are_walked_once(spark, monkeypatch):
    rng = random.Random(4)
    inputs = [(f"C{n}", k, rng.choice(["B1", "B2", V.ASSUMPTION, None, f"C{rng.randrange(n, 9)}", f"C{rng.randrange(9)}"])) for n in range(9) for k in range(rng.randrange(4))]
    inputs += [(f"CO{n}", 1, f"C{n % 9}") for n in range(30)] + [(f"CO{n}", 2, "B3") for n in range(30)] + [(V.ASSUMPTION, 1, "B1"), ("CN", 1, None)]
    cites = [(n, f"CO{n}") for n in range(30)] + [(50 + n, f"C{n}") for n in range(9)] + [(70, "B1"), (71, None), (72, "C77"), (73, V.ASSUMPTION), (74, "CN"), (75, "CO1"), (75, "C1")]
    stored, keep = {}, V._stored
    monkeypatch.setattr(V, "_stored", lambda df, name: stored.setdefault(name, keep(df, name)))
    found = V.evidence(spark.createDataFrame(cites, "figure_id int, cite string"), spark.createDataFrame(inputs, "calc_id string, no int, source_id string"), parts=3)
    assert sorted(str((r.figure_id, r.node, r.level, r["at"], r.calculation, r.leaf)) for r in found.collect()) == walked(cites, inputs)
    assert stored["below"].filter("calc_id like 'CO%'").isEmpty()  # levels are joined with what is shared only


def test_blocks_of_a_check_take_one_join(spark):
    assert plan_of(spark, "q53_block_check").count("SortMergeJoin") == 2  # and one with the answers; six before

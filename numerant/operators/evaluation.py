"""Scores of runs against answer keys, and summaries of arms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerant.functions.numeric import SIZE, close_to_display, is_percent
from numerant.operators.checking import as_asked, sign_of
from numerant.operators.figures import extract_figures
from numerant.operators.matching import matches
from numerant.operators.status import PASSING
from numerant.sources.tables import large

# Arithmetic in a line of working.
OPERATORS = r"[/×÷^]|\d\s*[*x]\s*\d"
FACTS = ["value", "neg", "scale", "unit", "currency", "size", "step"]
OPTIONAL = {"direction": 0, "unparsed": False, "raw": ""}


def claim_lines(text: Column) -> tuple[Column, Column]:
    """The claims of an answer, and the results of its lines of working: a line with "=" and an operator claims nothing,
    but what stands after its last "=" may supply a figure that is expected."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    working = lambda x: x.contains("=") & x.rlike(OPERATORS)
    results = F.transform(F.filter(lines, working), lambda x: F.element_at(F.split(x, "="), -1))
    return F.array_join(F.filter(lines, lambda x: ~working(x)), "\n"), F.array_join(results, "\n")


def same_figure(a: str = "a", e: str = "e") -> Column:
    """Whether a stated figure says an expected one (aliases of joined DataFrames)."""
    return says(lambda n: F.col(f"{a}.{n}"), lambda n: F.col(f"{e}.{n}"))


def says(stated: Callable[[str], Column], want: Callable[[str], Column], neg: Column | None = None) -> Column:
    """Whether the figure with the parts ``stated`` says the one with the parts ``want``, at any rounding of half a unit of
    its last digit and 25 % at most; ``neg`` is read for its own sign, if given."""
    percent = is_percent(stated("unit"))
    bare = stated("currency").isNull() & (stated("scale") == 0) & stated("unit").isNull()
    unit = percent | stated("unit").eqNullSafe(want("unit")) | bare
    currency = stated("currency").isNull() | want("currency").isNull() | (stated("currency") == want("currency"))
    said = sign_of(stated("neg") if neg is None else neg, stated("direction"))
    sign = (said == 0) | (said == F.when(want("neg"), -1).otherwise(1))
    near = close_to_display(stated("size"), stated("step"), want("size")) | (bare & close_to_display(stated("size"), stated("step"), want("value").cast(SIZE)))
    return ~stated("unparsed") & (percent == is_percent(want("unit"))) & unit & currency & sign & F.coalesce(near, F.lit(False))


def is_aside() -> Column:
    """Whether a figure's minus may be the brackets of an aside."""
    return F.col("neg") & F.trim("raw").startswith("(") & F.trim("raw").endswith(")")


def with_asides(figures: DataFrame) -> DataFrame:
    """The figures, and once more, without its sign, each bracketed one, which may be an aside instead of a minus."""
    return figures.unionByName(figures.filter(is_aside()).withColumn("neg", F.lit(False)))


def _known(figures: DataFrame, key: str) -> DataFrame:
    """Figures with all columns that are compared; where optional ones are missing, with what says nothing."""
    return figures.select(key, *FACTS, *[F.col(c) if c in figures.columns else F.lit(v).alias(c) for c, v in OPTIONAL.items()], *[c for c in ("figure_id",) if c in figures.columns])


def missing_figures(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """The expected figures (key, and the columns of a figure) that no found one says."""
    numbered = _known(expected, key).withColumn("_no", F.monotonically_increasing_id())
    met = numbered.alias("e").join(with_asides(_known(found, key)).alias("a"), F.col(f"e.{key}") == F.col(f"a.{key}"), "left")
    lost = met.groupBy("e._no").agg(F.any_value(f"e.{key}").alias(key), F.any_value("e.raw").alias("raw"), F.bool_or(same_figure()).alias("said"))
    return lost.filter(~F.coalesce("said", F.lit(False))).select(key, "raw")


def wrong_figures(stated: DataFrame, expected: DataFrame, key: str, asked: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """The stated figures (with figure_id) that no key expects or allows, no block of the question's documents holds and
    the question doesn't ask about. ``asked``: key, asked; ``blocks``: key and the columns of values. Unparsed ones are
    never wrong."""
    figures = stated.filter(~F.col("unparsed")) if "unparsed" in stated.columns else stated
    if asked is not None:
        figures = figures.withColumn("asked", as_asked()).join(asked, [key, "asked"], "left_anti")
    readings = with_asides(_known(figures, key))
    right = readings.alias("a").join(_known(expected, key).alias("e"), F.col(f"a.{key}") == F.col(f"e.{key}")).filter(same_figure()).select("a.figure_id")
    if blocks is not None:
        held = with_asides(figures).alias("f").join(blocks.alias("b"), F.col(f"f.{key}") == F.col(f"b.{key}")).filter(matches())
        right = right.union(held.select("f.figure_id"))
    return figures.join(right.distinct(), "figure_id", "left_anti").select(key, "figure_id", *[c for c in ("raw",) if c in figures.columns])


def missing_and_wrong(stated: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Per question of either side, how many expected figures no answer states, and how many stated ones no key expects."""
    numbered = stated if "figure_id" in stated.columns else stated.withColumn("figure_id", F.monotonically_increasing_id())
    missing = missing_figures(stated, expected, key).groupBy(key).agg(F.count(F.lit(1)).alias("missing"))
    wrong = wrong_figures(numbered, expected, key).groupBy(key).agg(F.count(F.lit(1)).alias("wrong"))
    every = stated.select(key).union(expected.select(key)).distinct()
    return every.join(missing, key, "left").join(wrong, key, "left").select(key, F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("wrong", F.lit(0)).alias("wrong"))


def key_entries(keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key: key, entries (an array of the figures of the arrays ``columns``, each with its column as ``kind``)
    and bad_key: whether some entry isn't one figure. Entries without a figure have one of nulls."""
    every = F.concat(*[_entries(c) for c in columns])
    listed = keys.select(key, F.posexplode(every).alias("no", "e")).select(key, "no", "e.kind", "e.raw").withColumn("_entry", F.concat_ws("#", F.col(key).cast("string"), "no"))
    found = extract_figures(listed, "_entry", "raw", exempt=False)
    figure = F.struct(*FACTS, "direction", "unparsed")
    one = found.groupBy("_entry").agg(F.count(F.lit(1)).alias("n"), F.min_by(figure, "pos").alias("figure"))
    joined = listed.join(large(one), "_entry", "left")
    entry = F.struct("kind", *[F.col(f"figure.{c}").alias(c) for c in [*FACTS, "direction", "unparsed"]])
    return joined.groupBy(key).agg(F.collect_list(entry).alias("entries"), F.bool_or(~F.coalesce(F.col("n") == 1, F.lit(False))).alias("bad_key"))


def _entries(column: str) -> Column:
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda t: F.struct(F.lit(column).alias("kind"), t.alias("raw")))


def score_answers(answers: DataFrame, keys: DataFrame, key: str = "qid", text: str = "text", question: str | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """One row per answer: key, correct, missing, wrong, unsaid (counts), bad_key and no_key.

    ``answers``: key (one answer each), text and optionally the question; ``keys``: key, and arrays expect, allow (of
    figures as text) and must_say (of patterns). ``blocks``: key and values that may be stated. An answer is correct that
    isn't blank, says every expected figure and every pattern, and no wrong figure. Answers without a key have no_key and
    nulls instead of a score. Null and empty answers say nothing; null arrays ask for nothing.

    Claims, lines of working and questions are read in one pass, and so are the keys; an answer's figures meet its key's
    in one row.
    """
    claims, results = claim_lines(F.col(text))
    read = [("claims", claims), ("results", results)] + ([("question", F.coalesce(question, F.lit("")))] if question else [])
    texts = answers.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("source"), c.alias("said")) for n, c in read])).alias("_t")).select(key, "_t.*")
    found = extract_figures(texts.withColumn("_id", F.concat_ws("#", F.col(key).cast("string"), "source")), "_id", "said", keep=(key, "source"))
    found = found.select(key, "_id", "pos", "source", is_aside().alias("aside"), *FACTS, "decimals", "direction", "unparsed", as_asked().alias("asked"))
    if blocks is None:
        found = found.withColumn("held", F.lit(False))
    else:
        own = [c for c in found.columns if c != "held"]
        pairs = found.alias("f").join(large(blocks.alias("b")), (F.col(f"f.{key}") == F.col(f"b.{key}")) & (F.col("f.source") == "claims"), "left")
        unsigned = F.col("f.aside") & matches("f", "b", neg=F.lit(False))
        found = pairs.groupBy("f._id", "f.pos").agg(*[F.any_value(f"f.{c}").alias(c) for c in own if c not in ("_id", "pos")], F.coalesce(F.bool_or(matches() | unsigned), F.lit(False)).alias("held"))
    figure = F.struct("source", "held", "aside", *FACTS, "direction", "unparsed", "asked")
    said = found.groupBy(key).agg(F.collect_list(figure).alias("said"))
    rows = answers.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(large(keys.select(key, "must_say", F.lit(True).alias("_has_key"))), key, "left")
    rows = rows.join(large(said), key, "left").join(large(key_entries(keys, key, ["expect", "allow"])), key, "left")
    nothing = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    rows = rows.withColumns({"said": nothing("said", said.schema["said"].dataType), "entries": nothing("entries", rows.schema["entries"].dataType)})

    def agree(f: Column, e: Column) -> Column:
        part = lambda x: lambda n: x[n]
        return F.coalesce(says(part(f), part(e)) | (f["aside"] & says(part(f), part(e), F.lit(False))), F.lit(False))

    claimed = F.filter("said", lambda f: f["source"] == "claims")
    rows = rows.withColumns({
        "_supplied": F.filter("said", lambda f: f["source"] != "question"), "_asked": F.transform(F.filter("said", lambda f: f["source"] == "question"), lambda f: f["asked"]),
        "_claimed": F.filter(claimed, lambda f: ~f["unparsed"] & ~f["held"]),
    })
    missing = F.size(F.filter("entries", lambda e: (e["kind"] == "expect") & ~F.exists("_supplied", lambda f: agree(f, e))))
    wrong = F.size(F.filter("_claimed", lambda f: ~F.array_contains("_asked", f["asked"]) & ~F.exists("entries", lambda e: agree(f, e))))
    unsaid = F.size(F.filter(F.coalesce("must_say", F.array().cast("array<string>")), lambda p: ~F.regexp_like(F.col("_text"), F.concat(F.lit("(?i)"), p))))
    scored = lambda c: F.when(F.col("_has_key"), c.cast("long"))
    out = rows.select(key, "_text", "_has_key", scored(missing).alias("missing"), scored(wrong).alias("wrong"), scored(unsaid).alias("unsaid"), F.coalesce("bad_key", F.lit(False)).alias("bad_key"), F.col("_has_key").isNull().alias("no_key"))
    right = (F.trim("_text") != "") & (F.col("missing") + F.col("wrong") + F.col("unsaid") == 0)
    return out.select(key, F.when(F.col("_has_key"), right).alias("correct"), "missing", "wrong", "unsaid", "bad_key", "no_key")


def traced_coverage(figures: DataFrame, key: str) -> DataFrame:
    """Per answer: how many figures pass, of how many that are not the question's own."""
    own = figures.filter(F.col("status") != "from_question")
    return own.groupBy(key).agg(F.count_if(F.col("status").isin(PASSING)).alias("passing"), F.count(F.lit(1)).alias("figures"))


def drafts(messages: DataFrame, session: str = "conv_id", pos: str = "turn") -> DataFrame:
    """One row per denial (an injected message of the user): session, pos, and the draft it denied: the last answer with
    text since the denial before, null if there is none. Only messages after the last real question count."""
    real = messages.filter((F.col("role") == "user") & ~F.coalesce("injected", F.lit(False))).groupBy(session).agg(F.max(pos).alias("_asked"))
    rows = messages.join(real, session, "left").filter(F.col(pos) > F.coalesce("_asked", F.lit(-1)))
    denial = (F.col("role") == "user") & F.coalesce("injected", F.lit(False))
    ahead = Window.partitionBy(session).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_denial", denial).withColumn("_round", F.coalesce(F.count_if(denial).over(ahead), F.lit(0)))
    said = F.when((F.col("role") == "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.struct(pos, "text"))
    return rows.groupBy(session, "_round").agg(F.max(F.when(F.col("_denial"), F.col(pos))).alias(pos), F.max(said)["text"].alias("draft")).filter(F.col(pos).isNotNull()).drop("_round")


def caught(wrong_in_drafts: DataFrame, final: DataFrame, key: str) -> DataFrame:
    """Wrong figures of denied drafts (key, raw) that the final answer (key, raw) no longer states."""
    return wrong_in_drafts.select(key, "raw").distinct().join(final.select(key, "raw"), [key, "raw"], "left_anti")


def arm_summary(runs: DataFrame) -> DataFrame:
    """Per arm: runs, correct ones, exact median and largest seconds, and the number of questions."""
    return runs.groupBy("arm").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("correct").alias("correct"), F.round(F.median("seconds"), 6).alias("median_seconds"),
        F.round(F.max("seconds"), 6).alias("most_seconds"), F.count_distinct("qid").alias("questions"),
    )


def arm_matrix(runs: DataFrame, arms: list[str]) -> DataFrame:
    """Questions by arms, each cell correct/all; null where an arm has no run."""
    cell = F.when(F.count(F.lit(1)) > 0, F.concat_ws("/", F.count_if("correct").cast("string"), F.count(F.lit(1)).cast("string")))
    return runs.groupBy("qid").pivot("arm", arms).agg(cell)

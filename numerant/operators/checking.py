"""Answers checked against what they cite: scopes of citations, figures in them, statuses, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerant.functions.numeric import SIZE, close_to_display, is_percent, power_of_ten
from numerant.functions.text import is_separator_row, normalised, row_cells, single_blanks
from numerant.lexicon import CITATION_ID, DERIVED_WORDS
from numerant.operators.figures import extract_figures
from numerant.operators.matching import in_year, kinds_of, matches, nearest
from numerant.operators.status import best_status
from numerant.operators.years import clause_year, pinned, single_year, years_in
from numerant.sources.tables import large

# Citations, runs of them, and abbreviations that end no sentence.
CITATION = rf"\[\s*{CITATION_ID}(?:\s*[,;]\s*{CITATION_ID})*\s*\]"
CITATION_RUN = rf"{CITATION}(?:[ \t]*{CITATION})*"
ABBREVIATIONS = r"vs|c|ca|e\.g|i\.e|approx|incl|no|p|pp"
_CUT, _DOT, _SEMICOLON = "\x01", "\x02", "\x03"


def prepared(answer: Column) -> Column:
    """Normalised, with citations that follow the end of a sentence moved in front of it."""
    return F.regexp_replace(normalised(F.coalesce(answer, F.lit(""))), rf"([.;!?])[ \t]*({CITATION_RUN})", " $2$1")


def clauses(line: Column) -> Column:
    """The sentences and clauses of a line; semicolons in citations and points of abbreviations end none."""
    t = F.regexp_replace(line, r";(?=[^\[\]]*\])", _SEMICOLON)
    t = F.regexp_replace(t, rf"(?i)\b({ABBREVIATIONS})\.(?=\s)", f"$1{_DOT}")
    t = F.regexp_replace(t, r"^(\s*\d+)\.(?=\s)", f"$1{_DOT}")
    t = F.regexp_replace(t, r"([.;!?]\s+)", f"$1{_CUT}")
    return F.filter(F.split(F.translate(t, _DOT + _SEMICOLON, ".;"), _CUT), lambda c: F.trim(c) != "")


def scopes(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """One row per scope: key, segment_id, scope_id (of a table, the row), text (without citations), cites, is_row; and
    for years clause_id, clause, offset (of the text in the clause) and fallback_year (of the clause, or of the cell's
    column header, else of its row's label); header is the cell's column header in lower case, empty elsewhere.

    In prose a run of citations closes the scope of the text since the one before; what follows the last has none. In a
    table every cell is a scope and the row's citations cover it; separator rows are left out. Null and empty answers
    have no scopes; an empty table gives no rows.
    """
    def lines_of(texts: DataFrame) -> DataFrame:
        return texts.select(F.col(key), F.posexplode(F.split(prepared(F.col(text)), "\n")).alias("line", "t")).filter(F.trim("t") != "")

    in_table = F.ltrim("t").startswith("|")

    def bare(t: Column) -> Column:
        return single_blanks(F.regexp_replace(t, CITATION_RUN, " "))

    # Where a piece begins in its clause is told by the pieces before it, so that clauses need no shuffle.
    prose = lines_of(answers).filter(~in_table).select(key, "line", F.posexplode(clauses(F.col("t"))).alias("clause_no", "t"))
    prose = prose.withColumn("pieces", F.split(F.regexp_replace("t", f"({CITATION_RUN})", f"$1{_CUT}"), _CUT)).withColumn("bares", F.transform("pieces", bare))
    prose = prose.withColumn("clause", F.array_join("bares", " "))
    prose = prose.select(key, "line", "clause_no", "clause", "bares", clause_year(F.col("clause")).alias("fallback_year"), F.posexplode_outer("pieces").alias("piece", "cited"))
    ahead = F.when(F.col("piece") > 0, F.length(F.array_join(F.slice("bares", F.lit(1), F.col("piece")), " ")) + 1).otherwise(0)
    prose = prose.select(key, "line", "clause_no", "clause", "fallback_year", "piece", F.get("bares", "piece").alias("t"), ahead.cast("long").alias("offset"), "cited").withColumn("is_row", F.lit(False)).withColumn("header", F.lit(""))

    # Only answers with a bar may have a table; the others are not prepared twice.
    rows = lines_of(answers.filter(F.col(text).contains("|"))).filter(in_table).withColumn("is_sep", is_separator_row(F.col("t")))
    rows = rows.withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy(key).orderBy("line")))
    table = Window.partitionBy(key, "island").orderBy("line")
    rows = rows.withColumn("nth", F.row_number().over(table)).withColumn("headed", F.lead("is_sep").over(table) & (F.col("nth") == 1))
    cells = row_cells(F.regexp_replace("t", CITATION_RUN, " "))
    rows = rows.withColumn("cells", cells).withColumn("heads", F.first(F.when(F.col("headed"), F.col("cells"))).over(table)).filter("not is_sep")
    rows = rows.select(key, "line", F.lit(0).alias("clause_no"), F.lit(0).alias("offset"), F.col("t").alias("cited"), "cells", "heads", "headed", F.posexplode_outer("cells").alias("piece", "t"))
    of_row = F.when(F.col("piece") > 0, single_year(F.element_at("cells", 1)))
    year = F.when(~F.coalesce("headed", F.lit(False)), F.coalesce(single_year(F.try_element_at("heads", F.col("piece") + 1)), of_row))
    header = F.when(F.coalesce("headed", F.lit(False)), F.lit("")).otherwise(F.coalesce(F.lower(F.try_element_at("heads", F.col("piece") + 1)), F.lit("")))
    rows = rows.withColumn("fallback_year", year).withColumn("header", header).withColumn("t", bare(F.col("t"))).withColumn("clause", F.col("t")).withColumn("is_row", F.lit(True)).drop("cells", "heads", "headed")

    every = prose.unionByName(rows)
    ids = F.regexp_extract_all("cited", F.lit(f"({CITATION_ID})(?=[^\\[\\]]*\\])"), 1)
    clause = F.concat_ws(".", F.col(key).cast("string"), "line", "clause_no")
    place = F.concat_ws(".", clause, "piece")
    scope = F.when(F.col("is_row"), F.concat_ws(".", F.col(key).cast("string"), "line")).otherwise(place)
    out = every.select(
        key, place.alias("segment_id"), scope.alias("scope_id"), F.col("t").alias("text"), ids.alias("cites"), "is_row",
        F.when(F.col("is_row"), place).otherwise(clause).alias("clause_id"), "clause", "offset", "fallback_year", "header",
    )
    return out.filter((F.trim("text") != "") | (F.size("cites") > 0))


def calculation_fits(f: str = "f", c: str = "c") -> Column:
    """Whether figure ``f`` may stand for the result of calculation ``c``: percentage, unit, currency, sign, size."""
    figure, calc = (lambda n: F.col(f"{f}.{n}")), (lambda n: F.col(f"{c}.{n}"))
    percent = is_percent(figure("unit"))
    result = calc("result").cast(SIZE)
    target = F.when(calc("is_percent"), (result * 100).cast(SIZE)).otherwise(result)
    amount = figure("currency").isNotNull() | (figure("scale") > 0)
    unit = F.when(percent, True).when(figure("unit").isNotNull(), figure("unit").eqNullSafe(calc("unit"))).otherwise(calc("unit").isNull() | ~amount)
    currency = figure("currency").isNull() | calc("currency").isNull() | (figure("currency") == calc("currency"))
    said = F.when(figure("neg") | (figure("direction") < 0), -1).when(figure("direction") > 0, 1).otherwise(0)
    sign = F.coalesce(calc("change_sign"), F.signum(target.cast("double")).cast("int"))
    bare = ~amount & figure("unit").isNull()
    scaled = (target / power_of_ten(F.coalesce(calc("scale"), F.lit(0)))).cast(SIZE)
    near = close_to_display(figure("size"), figure("step"), target) | (bare & (F.coalesce(calc("scale"), F.lit(0)) > 0) & close_to_display(figure("size"), figure("step"), scaled))
    return (percent == calc("is_percent")) & unit & currency & ((said == 0) | (sign == 0) | (said == sign)) & near


def stated_sign(side: str) -> Column:
    """-1 or 1 for a figure that states a sign: a minus or brackets, or a direction word before a change; else 0."""
    return sign_of(F.col(f"{side}.neg"), F.col(f"{side}.direction"))


def sign_of(neg: Column, direction: Column) -> Column:
    return F.when(neg | (direction < 0), -1).when(direction > 0, 1).otherwise(0)


def directions_agree(f: str = "f", b: str = "b") -> Column:
    """A figure that states no sign fits any value; one that does fits values of the same sign, of which those that state
    none are positive."""
    return (stated_sign(f) == 0) | (stated_sign(f) == F.when(stated_sign(b) < 0, -1).otherwise(1))


def near_derived_word() -> Column:
    """Whether one of the four words before a figure, or a word of its column's header, is that of a derived figure."""
    heads = F.regexp_extract_all("header", F.lit("[a-z]+"), 0)
    return F.arrays_overlap(F.concat("words", heads), F.array(*map(F.lit, DERIVED_WORDS)))


def as_asked() -> Column:
    """What makes a figure the same as one that the question states."""
    return F.struct(F.col("value"), F.col("scale"), is_percent(F.col("unit")).alias("percent"), F.coalesce("unit", F.lit("")).alias("unit"))


def checked_figures(answers: DataFrame, blocks: DataFrame, calculations: DataFrame | None = None, key: str = "answer_id", text: str = "text", question: str | None = None, valid: DataFrame | None = None) -> DataFrame:
    """One row per figure of each answer: key, figure_id, raw, the citation that decides, its status over all citations
    of its scope, and for a mismatch why: ``opposite`` (the sign), ``year`` (another column), what a value with the same
    digits differs in (``unit``, ``currency``, ``sign``, ``scale``, joined by +), ``absent``, or ``calculation``; and
    computable: a percentage, a change or a derived figure, which may have been computed.

    The first citation that passes counts, else the worst failure. ``blocks`` has a row per value (see
    ``block_values``); where it has year and years, figures with a year only fit that year's column, if there is one.
    ``calculations`` calc_id, result, is_percent, unit, currency, scale, change_sign, has_assumption; of those only the
    ones in ``valid`` (key, calc_id: made in this turn) may be cited, if it is given. Uncited figures that the
    ``question`` (a column of ``answers``) states too are ``from_question``.

    Scopes and questions are read once, together. Answers without figures have no rows; null and empty ones have none. A
    figure that cites nothing meets no block, so that the many without a citation are no common key.
    """
    parts = scopes(answers, key, text)
    carried = ["scope_id", "cites", "clause_id", "clause", "offset", "fallback_year", "header"]
    texts = parts.select(key, "segment_id", "text", *carried, F.lit(False).alias("asking"))
    if question is not None:
        empty = [(F.concat_ws(".", F.col(key).cast("string"), F.lit("?")) if c == "clause_id" else F.lit(None).cast(parts.schema[c].dataType)).alias(c) for c in carried]
        texts = texts.unionByName(answers.select(key, F.lit("?").alias("segment_id"), F.col(question).alias("text"), *empty, F.lit(True).alias("asking")))
    pins = {"year", "years"} <= set(blocks.columns)
    beside = {"years_in": years_in(F.col("clause"))} if pins else None
    found = extract_figures(texts, "segment_id", keep=(key, "cites", "clause_id", "offset", "fallback_year", "header", "asking"), beside=beside, together="clause_id")
    found = found.withColumn("_known", F.lit(False))
    if question is not None:
        asked = F.collect_set(F.when(F.col("asking"), as_asked())).over(Window.partitionBy(key))
        found = found.withColumn("_known", F.array_contains(asked, as_asked())).filter("not asking")
    found = found.withColumn("figure_id", F.concat_ws("#", "segment_id", F.col("pos").cast("string")))
    if pins:
        found = pinned(found)

    # One row per citation, or one for a figure without any; each meets a calculation or a block's values.
    each = found.withColumn("derived", near_derived_word()).withColumn("computable", is_percent(F.col("unit")) | F.col("change") | F.col("derived"))
    each = each.select("*", F.posexplode_outer(F.when(~F.col("unparsed"), F.col("cites"))).alias("at", "cite")).drop("words", "header", "cites")
    each = each.withColumn("calculated", F.coalesce(F.col("cite").rlike(r"^C\d+$"), F.lit(False)))
    each = each.withColumn("_by", F.coalesce("cite", F.concat(F.lit("-"), "figure_id")))
    each = _with_calculations(each, calculations, valid, key)
    for name, default in (("direction", 0), ("pos", 0)):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(default))
    joined = each.alias("f").join(large(blocks.withColumn("_there", F.lit(True)).alias("b")), F.col("f._by") == F.col("b.block"), "left")
    in_column = in_year() if pins else F.lit(True)
    rows = joined.select(
        *[F.col(f"f.{c}") for c in (key, "figure_id", "raw", "at", "cite", "unparsed", "_known", "calculated", "of_calculation", "explicit_change", "derived", "computable")],
        F.col("f.year").isNotNull().alias("has_year") if pins else F.lit(False).alias("has_year"), F.coalesce("b._there", F.lit(False)).alias("there"), matches().alias("fits"), F.coalesce(in_column, F.lit(True)).alias("in_column"),
        directions_agree().alias("agrees"), (F.col("f.value") == F.col("b.value")).alias("same"), F.when(~F.coalesce(matches() & in_column, F.lit(False)), nearest()).alias("near"),
    )
    fits = F.coalesce(F.col("fits") & F.col("in_column"), F.lit(False))
    signed = fits & F.col("agrees")
    checks = rows.groupBy(key, "figure_id", "raw", "at", "cite", "unparsed", "_known", "calculated", "of_calculation", "explicit_change", "derived", "computable", "has_year").agg(
        F.bool_or("there").alias("there"), F.bool_or(fits).alias("fits"), F.bool_or(signed).alias("signed"), F.bool_or(signed & F.col("same")).alias("exact"), F.bool_or("fits").alias("any_year"),
        F.min(F.when(F.col("in_column"), F.col("near"))).alias("near"), F.min("near").alias("near_any_year"),
    )
    by_block = (
        F.when(~F.col("there"), "phantom").when(F.col("explicit_change"), "derived_needs_calc").when(F.col("exact"), "traced")
        .when(F.col("derived") & (F.col("signed") | ~F.col("fits")), "derived_needs_calc").when(F.col("signed"), "traced").otherwise("mismatch")
    )
    uncited = F.when(F.col("_known"), "from_question").otherwise("untraced")
    status = F.when(F.col("unparsed"), "unparsed").when(F.col("cite").isNull(), uncited).when(F.col("calculated"), F.col("of_calculation")).otherwise(by_block)
    near = F.coalesce("near", F.when(F.col("has_year"), F.col("near_any_year")))
    kinds = F.when(near.isNotNull(), F.array_join(kinds_of(near.bitwiseAND(15)), "+"))
    why = F.when(F.col("calculated"), "calculation").when(F.col("fits"), "opposite").when(F.col("has_year") & F.col("any_year"), "year").otherwise(F.coalesce(kinds, F.lit("absent")))
    checks = checks.withColumn("status", status).withColumn("why", F.when(F.col("status") == "mismatch", why))
    return best_status(checks.withColumnRenamed("at", "pos"), key, "figure_id", "raw", also=("cite", "why", "computable"))


def _with_calculations(each: DataFrame, calculations: DataFrame | None, valid: DataFrame | None, key: str) -> DataFrame:
    """``each`` with of_calculation: the status by the calculation that is cited."""
    if calculations is None:
        return each.withColumn("of_calculation", F.lit("phantom"))
    made = calculations.withColumn("_made", F.lit(True))
    on = F.col("f._by") == F.col("c.calc_id")
    if valid is not None:
        made = made.join(valid.select(F.col(key).alias("_answer"), "calc_id").distinct(), "calc_id")
        on = on & (F.col(f"f.{key}") == F.col("c._answer"))
    joined = each.alias("f").join(large(made.alias("c")), on, "left")
    status = F.when(F.col("c._made").isNull(), "phantom").when(~F.coalesce(calculation_fits(), F.lit(False)), "mismatch").when(F.col("c.has_assumption"), "calculated_with_assumption").otherwise("calculated")
    return joined.select("f.*", status.alias("of_calculation"))


def empty_citations(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """Scopes that have citations but no figure: key, scope_id, cites."""
    parts = scopes(answers, key, text).filter(F.size("cites") > 0)
    filled = extract_figures(parts, "segment_id", keep=("scope_id",)).select("scope_id").distinct()
    return parts.join(filled, "scope_id", "left_anti").select(key, "scope_id", "cites").distinct()

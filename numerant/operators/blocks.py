"""Values of source blocks: the figures of tables and texts, with columns, years and inherited units.

Lines, cells and columns are arrays of their block's row, with what their headers and unit rows say. Figures come from
``extract_figures``, meet their block's row in one join and find their line and column by their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerant.functions.numeric import currency_code, literal_map, size_of, step_of
from numerant.functions.text import is_separator_row, normalised, row_cells
from numerant.lexicon import CODES, HEADER_SCALES
from numerant.operators.figures import extract_figures
from numerant.sources.tables import large

# How headers state scales and currencies, and cells that hold only a unit.
CODE_RX = "|".join(CODES)
SCALE_WORDS = r"(?:m|mn|bn|k|'000s?|000s|millions?|thousands?|billions?)"
HEADER_SCALE = [rf"(?i)(?:\b(?:{CODE_RX})|US\$|[£€$])\s?({SCALE_WORDS})(?![\w'])", rf"(?i)\((?:US\$|[£€$]|{CODE_RX})?\s?({SCALE_WORDS})\)", r"(?i)\bin\s+('?000s|millions|thousands|billions)(?![\w'])"]
HEADER_CURRENCY = rf"(?i)(?:\b({CODE_RX})|(US\$|[£$€]))\s?{SCALE_WORDS}\b|\((?:({CODE_RX})|(US\$|[£$€]))\s?{SCALE_WORDS}?\)"
CURRENCY = rf"(?i){CODE_RX}|US\$|[£$€]"
UNIT_CELL = rf"(?i)^(?:({CODE_RX})|(US\$|[£$€]))?\s?('000|thousands?|millions?|billions?|mn|bn|m|k)?$"
PER_SHARE = {"c": "c", "cent": "c", "cents": "c", "us cents": "c", "¢": "c", "p": "p", "pence": "p"}


def stated_scale(text: Column) -> Column:
    """The power of ten that a header or caption states first; 0 if none."""
    out = F.lit(0)
    for pattern in reversed(HEADER_SCALE):
        word = F.lower(F.regexp_extract(text, pattern, 1))
        out = F.when(word != "", F.coalesce(literal_map(HEADER_SCALES)[word], F.lit(3))).otherwise(out)
    return out


def stated_currency(text: Column) -> Column:
    """The only currency that a header states, else null."""
    found = F.regexp_extract_all(text, F.lit(HEADER_CURRENCY), 0)
    codes = F.array_distinct(F.transform(found, lambda g: currency_code(F.regexp_extract(g, CURRENCY, 0))))
    return F.get(F.transform(F.filter(F.array(codes), lambda c: F.size(c) == 1), lambda c: F.get(c, F.lit(0))), F.lit(0))


def unit_of_cell(cell: Column) -> Column:
    """struct(unit, scale, currency) of a cell that holds only a unit; null for any other."""
    share = literal_map(PER_SHARE)[F.lower(cell)]
    code, symbol, word = (F.regexp_extract(cell, UNIT_CELL, k) for k in (1, 2, 3))
    only = cell.rlike(UNIT_CELL) & ((code != "") | (symbol != "") | (word != ""))
    scale = F.coalesce(literal_map(HEADER_SCALES)[F.lower(word)], F.lit(0))
    amount = F.struct(F.lit(None).cast("string").alias("unit"), scale.alias("scale"), currency_code(F.concat(code, symbol)).alias("currency"))
    per = F.struct(share.alias("unit"), F.lit(0).alias("scale"), F.lit(None).cast("string").alias("currency"))
    return F.when(share.isNotNull(), per).when((cell != "") & only, amount)


def _lines_of(blocks: DataFrame) -> DataFrame:
    """One row per block: its text and caption, ``_begins`` (of its lines, and the end), ``_lines`` (in_table, is_head, label,
    row_scale, row_currency, and what it says of the units below it: ``spec``, of a line of text nothing), ``_heads`` (year
    and is_note of its columns) and years. Lines and cells are arrays, as a text is read where it lies."""
    rows = blocks.withColumn("_t", F.split("text", "\n"))
    # A sum so far is kept in its array's last place.
    ends = F.aggregate("_t", F.array(F.lit(0)), lambda so_far, t: F.concat(so_far, F.array(F.element_at(so_far, -1) + F.length(t) + 1)))
    rows = rows.withColumn("_l", F.transform("_t", lambda t: F.struct(t.alias("t"), F.when(F.ltrim(t).startswith("|"), row_cells(t)).alias("cells"))))
    separators = F.transform("_l", lambda x: F.coalesce(x["cells"].isNotNull() & F.contains(x["t"], F.lit("--")) & is_separator_row(x["t"]), F.lit(False)))
    rows = rows.withColumns({"_begins": ends, "_seps": separators}).withColumn("_sep", F.array_position("_seps", True).cast("int") - 1)

    # Columns: what their headers say.
    rows = rows.withColumn("_head_cells", F.filter(F.transform(F.slice("_l", F.lit(1), F.greatest("_sep", F.lit(0))), lambda x: x["cells"]), lambda c: c.isNotNull()))
    width = F.coalesce(F.array_max(F.transform("_head_cells", lambda c: F.size(c))), F.lit(0))
    columns = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    headers = F.transform(columns, lambda j: F.trim(F.array_join(F.transform("_head_cells", lambda c: F.get(c, j)), " ")))
    told = F.transform(headers, lambda h: F.struct(h.alias("h"), F.array_distinct(F.regexp_extract_all(h, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1)).alias("years")))
    year = lambda x: F.when((F.size(x["years"]) == 1) & ~F.contains(x["h"], F.lit("/")), F.get(x["years"], F.lit(0)).cast("int"))
    rows = rows.withColumn("_heads", F.transform(told, lambda x: F.struct(year(x).alias("year"), F.lower(x["h"]).isin("note", "notes").alias("is_note"))))
    rows = rows.withColumn("years", F.sort_array(F.array_distinct(F.filter(F.transform("_heads", lambda h: h["year"]), lambda y: y.isNotNull()))))

    # Unit rows: every cell but the first is empty or a unit. Lines of text end what they say.
    def said(x: Column, i: Column) -> Column:
        filled = F.filter(F.slice(x["cells"], 2, 1000), lambda c: c != "")
        is_unit = (i > F.col("_sep")) & ~F.get("_seps", i) & (F.size(filled) > 0) & F.forall(filled, lambda c: unit_of_cell(c).isNotNull())
        label = F.get(x["cells"], F.lit(0))
        return F.struct(
            x["t"].alias("t"), x["cells"].isNotNull().alias("in_table"), (x["cells"].isNotNull() & (i < F.col("_sep"))).alias("is_head"), label.alias("label"),
            F.when(x["cells"].isNull(), F.array().cast("array<struct<unit:string,scale:int,currency:string>>")).when(is_unit, F.transform(x["cells"], lambda c: unit_of_cell(c))).alias("spec"),
            F.when(x["cells"].isNotNull(), stated_scale(label)).otherwise(0).alias("row_scale"),
        )

    rows = rows.withColumn("_lines", F.transform("_l", said))
    return rows.select("block", "text", "caption", "_begins", "_lines", "_heads", "years")


def block_values(blocks: DataFrame) -> DataFrame:
    """One row per value that may be cited: block, pos, raw, label, col, year, years, and the figure's columns with unit,
    scale and currency as inherited: its own, else of a unit row above it in its column, else of its row's label, else
    of the block's header or its caption.

    ``blocks``: block, text and optionally caption. Values in headers and note columns, years and unparsed figures are
    left out. Null and empty texts have no values; an empty table gives no rows. Figures are dealt out by their block and
    are one row again before they meet its lines, so that nothing else is shuffled and no line is joined with all figures.
    """
    caption = normalised(F.coalesce(F.col("caption"), F.lit(""))) if "caption" in blocks.columns else F.lit("")
    base = blocks.select("block", normalised(F.coalesce("text", F.lit(""))).alias("text"), caption.alias("caption"))
    found = extract_figures(base.select("block", "text"), "block", exempt=False, together="block")

    own = F.col("unit").isNotNull() | (F.col("scale") > 0)
    plain = F.col("value").between(1900, 2099) & (F.col("decimals") == 0) & ~F.col("raw").contains(",")
    bare_year = plain & ~F.col("neg") & F.col("currency").isNull() & ~own
    yearish = plain & ~F.coalesce(F.col("unit").isin("%", "pp", "bps"), F.lit(False))
    found = found.filter(~F.col("unparsed")).withColumns({"_data": ~yearish, "_counts": ~bare_year})
    figure = F.struct("pos", "raw", "start", "value", "neg", "decimals", "direction", "unit", "scale", "currency", "_counts", "_data")
    figures = found.groupBy("block").agg(F.collect_list(figure).alias("_figures"))
    rows = _lines_of(base).join(large(figures), "block")

    # What the block states: lines of text, and of its table what lies above the first line with data.
    line_of = lambda at: F.size(F.filter("_begins", lambda b: b <= at)) - 1
    at_line = F.transform(F.filter("_figures", lambda f: f["_data"]), lambda f: line_of(f["start"]))
    data = F.filter(at_line, lambda n: F.get("_lines", n)["in_table"] & ~F.get("_lines", n)["is_head"])
    rows = rows.withColumn("_first", F.array_min(data))
    above = F.filter("_lines", lambda x, i: ~x["in_table"] | F.col("_first").isNull() | (i < F.col("_first")))
    rows = rows.withColumn("_above", F.array_join(F.transform(above, lambda x: x["t"]), "\n")).withColumn("_stated", stated_scale(F.col("_above")))
    rows = rows.withColumn("scope", F.when(F.col("_stated") == 0, F.concat("caption", F.lit("\n"), "_above")).otherwise(F.col("_above")))
    rows = rows.withColumn("block_scale", F.when((F.col("_stated") == 0) & (F.col("caption") != ""), stated_scale(F.col("scope"))).otherwise(F.col("_stated")))
    rows = rows.withColumn("block_currency", F.coalesce(stated_currency(F.col("scope")), stated_currency(F.col("text"))))

    # Figures again, in their lines and columns.
    placed = rows.select("text", "_begins", "_lines", "_heads", "years", "block", "block_scale", "block_currency", F.inline("_figures")).withColumn("_no", line_of(F.col("start")))
    placed = placed.withColumn("_line", F.get("_lines", "_no")).withColumn("in_table", F.col("_line.in_table")).filter("_counts and not _line.is_head")
    ahead = F.substring(F.col("_line.t"), F.lit(1), F.col("start") - F.get("_begins", "_no"))
    placed = placed.withColumn("_ahead", ahead).withColumn("col", F.when(F.col("in_table"), F.length("_ahead") - F.length(F.replace("_ahead", F.lit("|"), F.lit(""))) - 1))
    placed = placed.withColumn("_head", F.get("_heads", "col")).filter(~F.coalesce(F.col("_head.is_note"), F.lit(False))).withColumn("year", F.col("_head.year"))
    words = F.regexp_extract_all(F.element_at(F.split("_ahead", r"[.;:!?](?:\s|$)|[()]"), -1), F.lit(r"[A-Za-z][A-Za-z'&/-]*"), 0)
    placed = placed.withColumn("_words", F.when(~F.col("in_table"), words))
    placed = placed.withColumn("label", F.when(F.col("in_table"), F.col("_line.label")).otherwise(F.array_join(F.slice("_words", F.greatest(F.size("_words") - 5, F.lit(1)), 6), " ")))
    specs = F.filter(F.transform(F.slice("_lines", F.lit(1), F.col("_no") + 1), lambda x: x["spec"]), lambda s: s.isNotNull())
    inherits = F.col("unit").isNull() & (F.col("scale") == 0)
    of_row = inherits & F.col("currency").isNull() & F.col("in_table") & (F.col("col") >= 0)
    placed = placed.withColumns({"inherits": inherits, "by_row": F.when(of_row, F.try_element_at(F.try_element_at(specs, F.lit(-1)), F.col("col") + 1))})
    by_row = F.col("by_row")
    by_label = F.col("inherits") & by_row.isNull() & (F.col("_line.row_scale") > 0)
    unit = F.coalesce("unit", by_row["unit"])
    scale = F.when(F.col("scale") > 0, F.col("scale")).when(unit.isNotNull(), 0).when(by_row.isNotNull(), by_row["scale"]).when(by_label, F.col("_line.row_scale")).otherwise(F.col("block_scale"))
    # A share count in millions has no currency although the block has one: "" says so.
    of_label = F.coalesce(stated_currency(F.col("_line.label")), F.lit(""))
    currency = F.when(F.col("currency").isNotNull(), F.col("currency")).when(unit.isNotNull(), None).when(by_row.isNotNull(), F.coalesce(by_row["currency"], F.lit(""))).when(by_label, of_label).otherwise(F.col("block_currency"))
    out = placed.select("block", "pos", "raw", "label", "col", "year", F.col("years"), "value", "neg", "decimals", "direction", unit.alias("unit"), scale.alias("scale"), currency.alias("currency"))
    return out.withColumns({"size": size_of(F.col("value"), F.col("scale"), F.col("unit")), "step": step_of(F.col("decimals"), F.col("scale"), F.col("unit"))})

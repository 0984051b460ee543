"""Years in answers: which figure each one speaks of."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A year on its own, periods (whose years pin nothing), and words of comparison.
YEAR = r"(?i)(?<![\d.,/–-])(?:FY\s?)?((?:19|20)\d{2})(?!\d|[.,]\d|\s?[-–/]\s?\d)"
PERIOD = r"(?i)(?:\b(?:from|between)\s+)?(?:FY\s?)?(?:19|20)\d{2}(?:\s*[-–/]\s*|\s+(?:to|until|through|and|vs\.?|versus)\s+)(?:FY\s?)?(?:19|20)\d{2}\b"
COMPARING = r"(?i)\b(?:from|compared|versus|vs\.?|against|prior|previous|preceding|before|earlier|last year|a year ago)\b"
# What a text must hold for a year, and for a period, to be found.
_ONE = r"(?:19|20)\d{2}"
_TWO = rf"(?s){_ONE}.*{_ONE}"


def single_year(text: Column) -> Column:
    """The only year of a text, not counting those of periods; else null."""
    single = F.when(text.rlike(_TWO), F.regexp_replace(text, PERIOD, " ")).otherwise(text)
    years = F.array_distinct(F.regexp_extract_all(single, F.lit(YEAR), 1))
    return F.when(F.size(years) == 1, F.element_at(years, 1).cast("int"))


def clause_year(text: Column) -> Column:
    """The one year that a clause is about; null where it compares. Years in brackets belong to their own figures."""
    return F.when(text.rlike(_ONE) & ~text.rlike(COMPARING), single_year(F.regexp_replace(text, r"\([^)]*\)", " ")))


_SPOTS = pa.list_(pa.struct([("year", pa.int32()), ("y_start", pa.int32()), ("y_stop", pa.int32()), ("forward", pa.bool_())]))
_PERIOD, _YEAR, _CENTURY = re.compile(PERIOD), re.compile(YEAR), re.compile("19|20")
_LEAD = 3  # characters of "FY " before a year
REACH = 15  # characters between a year and its figure


def _spots(texts: pa.Array) -> pa.Array:
    def of(text: str) -> list[dict]:
        first = _CENTURY.search(text)
        if first is None:
            return []
        plain = _PERIOD.sub(lambda m: "\x00" * len(m[0]), text) if _CENTURY.search(text, first.end()) else text
        found = _YEAR.finditer(plain, max(0, first.start() - _LEAD))
        return [{"year": int(m[1]), "y_start": m.start(), "y_stop": m.end(), "forward": text[m.end() : m.end() + 1] == ":"} for m in found]

    return pa.array([None if t is None else of(t) for t in texts.to_pylist()], _SPOTS)


def years_in(clause: Column) -> Column:
    """Where years stand in a clause (null without any): a column for ``extract_figures(beside=...)``, so that clauses go
    to Python along with the texts."""
    find = F.arrow_udf(_spots, "array<struct<year int, y_start int, y_stop int, forward boolean>>")
    return find(F.when(clause.rlike(YEAR), clause))


def pinned(figures: DataFrame) -> DataFrame:
    """``figures`` (clause_id, offset, start, stop, fallback_year, years_in) with ``year``: that of a year within ``REACH``
    characters, else the fallback.

    Each year of a clause goes to its nearest figure (after a colon, the next one first); one that stands in a figure
    goes to none, and a figure that gets two different years gets none of them. A clause's figures are looked at
    together, by one task.
    """
    low, high = F.col("start") + F.col("offset"), F.col("stop") + F.col("offset")
    rows = figures.withColumn("_of_clause", F.when(F.size("years_in") > 0, F.collect_list(F.struct(low.alias("low"), high.alias("high"))).over(Window.partitionBy("clause_id"))))

    def gap(f: Column, y: Column) -> Column:
        return F.when(f["low"] >= y["y_stop"], f["low"] - y["y_stop"]).when(f["high"] <= y["y_start"], y["y_start"] - f["high"])

    def goes_to(y: Column) -> Column:
        near = F.filter("_of_clause", lambda f: gap(f, y) <= REACH)
        first = F.array_min(F.transform(near, lambda f: F.struct((~(y["forward"] & (f["low"] >= y["y_stop"]))).alias("later"), gap(f, y).alias("gap"), f["low"].alias("low"))))
        return F.when(~F.exists("_of_clause", lambda f: gap(f, y).isNull()), first["low"])

    own = F.array_distinct(F.transform(F.filter("years_in", lambda y: F.coalesce(goes_to(y) == low, F.lit(False))), lambda y: y["year"]))
    year = F.when(F.size("_of_clause") > 0, F.when(F.size(own) == 1, F.get(own, F.lit(0))))
    return rows.withColumn("year", F.coalesce(year, "fallback_year")).drop("_of_clause", "years_in")

"""What is told of checks: verdict lines and summaries as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_VIEWS = 12


def verdicts(counts: DataFrame, key: str) -> DataFrame:
    """key, ok and verdict for rows of ``status_counts``; rows whose counts are null were not checked, and say so."""
    total = F.col("traced") + F.col("calculated") + F.col("from_question") + F.col("unsupported")
    ok = (F.col("unsupported") == 0) & total.isNotNull()
    found = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {name}"))) for c, name in (("traced", "traced"), ("calculated", "calculated"), ("from_question", "from the question"), ("unsupported", "unsupported"))])
    line = F.when(total.isNull(), "NOT CHECKED").when(total == 0, "no figures").otherwise(F.concat(total.cast("string"), F.lit(" figures: "), found))
    return counts.select(key, F.coalesce(ok, F.lit(False)).alias("ok"), line.alias("verdict"))


def views(checks: DataFrame, question: str, at: str, most: int = MOST_VIEWS) -> DataFrame:
    """The checks that a report shows: the newest of each question, newest first; ``view`` counts from 1.

    Checks that were not made (decision not_checked) count only where a question has no other.
    """
    made = F.col("decision") != "not_checked"
    newest = F.row_number().over(Window.partitionBy(question).orderBy(made.desc(), F.desc(at)))
    first = checks.withColumn("_r", newest).filter("_r = 1").drop("_r")
    return first.orderBy(F.desc(at), question).limit(most).withColumn("view", F.row_number().over(Window.orderBy(F.desc(at), question)))


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per row, as a line of a Markdown table: what a summary is written from."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return rows.select(*columns, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))

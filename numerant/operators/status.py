"""What becomes of a figure, and of an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerant.operators.matching import cited_matches

PASSING = ["traced", "calculated", "calculated_with_assumption", "from_question"]
#: The failure that is told when several citations fail: the highest, then the first.
PRIORITY = {"phantom": 1, "mismatch": 2, "derived_needs_calc": 3}


def figure_statuses(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """``figures`` (figure_id, block, and the figure's columns) with status.

    No citation: untraced; a block that isn't there: phantom; a change that cites a block: derived_needs_calc; a value
    that fits: traced; else mismatch. Columns ``unparsed`` and ``explicit_change`` are optional.
    """
    checked = cited_matches(figures, blocks, "block")
    unparsed = F.col("unparsed") if "unparsed" in figures.columns else F.lit(False)
    change = F.col("explicit_change") if "explicit_change" in figures.columns else F.lit(False)
    status = F.when(unparsed, "unparsed").when(F.col("block").isNull(), "untraced").when(~F.col("known"), "phantom").when(change, "derived_needs_calc").when(F.col("hits") > 0, "traced").otherwise("mismatch")
    return checked.withColumn("status", status)


def best_status(checks: DataFrame, *keys: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Of a figure's citations (keys, pos, status) the first that passes, else the worst failure, the first of equals;
    with the columns ``also`` of that citation."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])[F.col("status")], F.when(F.col("status").isin(PASSING), 9).otherwise(0))
    best = checks.groupBy(*keys).agg(F.max_by(F.struct("status", *also), F.struct(rank, -F.col("pos"))).alias("_best"))
    return best.select(*keys, "_best.*")


def answer_decisions(figures: DataFrame, key: str) -> DataFrame:
    """One row per answer: figures, problems and the decision; an answer is denied for any figure that fails."""
    bad = ~F.col("status").isin(PASSING)
    return figures.groupBy(key).agg(F.count(F.lit(1)).alias("figures"), F.count_if(bad).alias("problems"), F.when(F.bool_or(bad), "deny").otherwise("allow").alias("decision"))


def status_counts(figures: DataFrame, key: str) -> DataFrame:
    calculated = F.col("status").isin("calculated", "calculated_with_assumption")
    return figures.groupBy(key).agg(
        F.count_if(F.col("status") == "traced").alias("traced"), F.count_if(calculated).alias("calculated"),
        F.count_if(F.col("status") == "from_question").alias("from_question"), F.count_if(~F.col("status").isin(PASSING)).alias("unsupported"),
    )

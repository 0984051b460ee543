"""What is said of a checked answer: problems in words, suggestions, and the decision with its message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerant.operators.status import PASSING

# Attempts that an answer has, and what a denial asks for.
MOST_ATTEMPTS = 4
MOST_HINTS = 5  # figures of an answer for which other blocks are named
COMPUTED = "; if it was computed, calculate it and cite the calculation"
REWRITE = "Rewrite the full answer with a citation right after every figure; compute derived and change figures and cite the calculation."
NO_DOCUMENTS = "No source documents were read: read them, or say that the figures are not from documents."


def question_id(session: Column, position: Column, question: Column) -> Column:
    """The same for all attempts at a question, another for the next one: twelve hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("\n", F.coalesce(session, F.lit("")), position.cast("string"), F.coalesce(question, F.lit(""))), 256), 1, 12)


def place_of(figure_id: Column) -> Column:
    """The order of figures: the numbers that their ids are made of."""
    return F.transform(F.split(figure_id, r"[.#]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def figure_problems(figures: DataFrame, hints: DataFrame | None = None, key: str = "answer_id") -> DataFrame:
    """The figures that fail (key, figure_id, raw, cite, status, why, computable) with ``problem``: what is wrong, in words.
    ``hints`` has figure_id and ``found``, the blocks that hold such a value: they are told for the first ``MOST_HINTS``
    figures of an answer that are not where they should be."""
    raw = F.concat(F.lit("'"), F.trim("raw"), F.lit("'"))
    cite = F.coalesce("cite", F.lit(""))
    told = {
        "unit": F.concat(F.lit("is in another unit than the value with its digits in "), cite), "currency": F.concat(F.lit("has another currency than "), cite),
        "sign": F.concat(F.lit("is negative but positive in "), cite), "scale": F.concat(F.lit("has another scale than "), cite),
    }
    kinds = F.split(F.coalesce("why", F.lit("")), r"\+")
    near = F.concat_ws(", and ", *[F.when(F.array_contains(kinds, k), words) for k, words in told.items()])
    reason = (
        F.when(F.col("why") == "opposite", F.concat(F.lit("has the opposite sign or direction to "), cite)).when(F.col("why") == "year", F.concat(F.lit("is in "), cite, F.lit(" but not in its year's column")))
        .when(F.col("why") == "calculation", F.concat(F.lit("does not match "), cite)).when(near != "", near).otherwise(F.concat(F.lit("is not in "), cite))
    )
    text = (
        F.when(F.col("status") == "unparsed", F.concat(F.lit("unparsed figure "), raw, F.lit(": write it with a standard unit"))).when(F.col("status") == "untraced", F.concat(raw, F.lit(" has no citation")))
        .when(F.col("status") == "phantom", F.concat(raw, F.lit(" cites "), cite, F.lit(", which does not exist in this turn")))
        .when(F.col("status") == "derived_needs_calc", F.concat(raw, F.lit(" is a change or a derived figure: compute it and cite its calculation"))).otherwise(F.concat(raw, F.lit(" "), reason))
    )
    bad = figures.filter(~F.col("status").isin(PASSING)).withColumn("_absent", F.coalesce(F.col("why") == "absent", F.lit(False)))
    if hints is None:
        bad = bad.withColumn("_at", F.lit(None).cast("string"))
    else:
        nth = F.row_number().over(Window.partitionBy(key, "_absent").orderBy(place_of(F.col("figure_id"))))
        found = hints.select("figure_id", F.array_join(F.transform("found", lambda b: b.cast("string")), ", ").alias("_found"))
        bad = bad.withColumn("_nth", nth).join(found, "figure_id", "left").withColumn("_at", F.when(F.col("_nth") <= MOST_HINTS, F.col("_found"))).drop("_nth", "_found")
    more = F.concat(F.coalesce(F.concat(F.lit("; it appears in "), "_at"), F.lit("")), F.when(F.coalesce("computable", F.lit(False)), COMPUTED).otherwise(""))
    return bad.withColumn("problem", F.when(F.col("_absent"), F.concat(text, more)).otherwise(text)).drop("_at", "_absent")


def empty_problems(empty: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """For scopes that cite without a figure (key, scope_id, cites): the problem, with the first value of the first of
    the cited blocks that has one as an example."""
    each = empty.select(key, "scope_id", "cites", F.posexplode("cites").alias("at", "block"))
    first = blocks.groupBy("block").agg(F.min_by("raw", "pos").alias("example"))
    shown = each.join(first, "block").groupBy(key, "scope_id").agg(F.min_by(F.concat(F.lit(", for example "), F.trim("example"), F.lit(" ["), "block", F.lit("]")), "at").alias("_example"))
    ids = F.array_join(F.transform("cites", lambda c: F.concat(F.lit("["), c, F.lit("]"))), "")
    text = F.concat(F.lit("citation "), ids, F.lit(" has no figure next to it. Put the figure next to its citation"), F.coalesce("_example", F.lit("")))
    return empty.join(shown, [key, "scope_id"], "left").select(key, "scope_id", text.alias("problem"))


def decisions(answers: DataFrame, figures: DataFrame, problems: DataFrame, key: str, at: list[str], question: str = "question") -> DataFrame:
    """One row per answer: key, decision (allow, deny, not_checked), attempt and message.

    ``answers``: key, the question it is an attempt at, the columns ``at`` that order attempts, text, reason (why it could
    not be checked, else null), has_ledger and has_documents. ``figures``: key, status, cite; ``problems``: key, place (the order of
    problems) and problem. Nothing to check and no ledger: allowed without a word. A reply without figures after a denial
    of the same question is allowed, but says so.
    """
    counted = figures.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("status").isin(PASSING)).alias("_bad"), F.count_if(F.col("status") == "from_question").alias("_asked"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") == "calculated_with_assumption", F.col("cite")))), ", ").alias("_assumed"),
    )
    empty = F.count_if("empty") if "empty" in problems.columns else F.lit(0).cast("long")
    listed = problems.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "problem"))).alias("_problems"), empty.alias("_empty"))
    rows = answers.join(counted, key, "left").join(listed, key, "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_bad": F.coalesce("_bad", F.lit(0)), "_asked": F.coalesce("_asked", F.lit(0))})
    denied = F.size(F.coalesce("_problems", F.array())) > 0
    rows = rows.withColumn("decision", F.when(F.col("reason").isNotNull(), "not_checked").when(denied, "deny").otherwise("allow"))
    order = Window.partitionBy(question).orderBy(*at)
    made = F.col("reason").isNull() & (F.col("has_ledger") | denied | (F.col("_n") > 0))
    rows = rows.withColumn("attempt", F.when(made, F.count_if(made).over(order))).withColumn("_before", F.coalesce(F.bool_or(F.col("decision") == "deny").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    lines = F.array_join(F.transform("_problems", lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p["problem"])), "\n")
    head = F.when(F.col("_n") > 0, F.concat(F.lit("Untraced figures ("), F.col("_bad").cast("string"), F.lit(" of "), F.col("_n").cast("string"), F.lit(")"), F.when(F.col("_empty") > 0, F.concat(F.lit(", citations without a figure: "), F.col("_empty").cast("string"))).otherwise(""))).otherwise("Citations without a figure")
    body = F.when(~F.col("has_documents"), F.lit(NO_DOCUMENTS)).otherwise(F.concat(head, F.lit(":\n"), lines, F.lit("\n" + REWRITE)))
    fine = F.concat_ws(
        " · ", F.concat(F.lit("traceable: "), (F.col("_n") - F.col("_asked")).cast("string"), F.lit(" figures traced")), F.when(F.col("_asked") > 0, F.concat(F.col("_asked").cast("string"), F.lit(" from your question, not verified"))),
        F.when(F.col("_assumed") != "", F.concat("_assumed", F.when(F.col("_assumed").contains(","), F.lit(" use assumed inputs")).otherwise(F.lit(" uses an assumed input")))),
    )
    message = (
        F.when(F.col("reason").isNotNull(), F.concat(F.lit("NOT CHECKED: "), F.col("reason"))).when(denied, F.concat(F.lit("Attempt "), F.col("attempt").cast("string"), F.lit(f" of {MOST_ATTEMPTS}. "), body))
        .when(F.col("_n") > 0, fine).when(F.col("_before"), F.lit("the final answer states no figures; an earlier draft was denied and its figures are not verified"))
    )
    return rows.select(key, question, "decision", "attempt", F.when(F.col("has_ledger") | denied | (F.col("_n") > 0) | F.col("reason").isNotNull(), message).alias("message"))


def denials(checks: DataFrame, question: str) -> DataFrame:
    """Per question: checks and denials among them."""
    return checks.groupBy(question).agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("decision") == "deny").alias("denials"))

"""Transcripts: which message is the question, which the answer, and which attempt a check is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numerant.lexicon import CITATION_ID
from numerant.operators.figures import extract_figures

CITATION = rf"\[\s*{CITATION_ID}(?:\s*[,;]\s*{CITATION_ID})*\s*\]"


def selected_answers(messages: DataFrame, session: str = "conv_id", pos: str = "turn") -> DataFrame:
    """Per session: the last real question of the user (q_pos, question) and the last answer that isn't empty after the
    user's last message, written or injected: what an injected denial is about is no answer any more.

    ``messages``: session, pos, role, text, and optionally injected (messages that no user wrote). Sessions without a
    question are left out; without an answer it is null.
    """
    real = (F.col("role") == "user") & (~F.col("injected") if "injected" in messages.columns else F.lit(True))
    asked = messages.filter(real).groupBy(session).agg(F.max(pos).alias("q_pos"), F.max_by("text", pos).alias("question"))
    answers = messages.filter((F.col("role") == "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    last_said = messages.filter(F.col("role") == "user").groupBy(session).agg(F.max(pos).alias("_begin"))
    later = answers.join(last_said, session).filter(F.col(pos) > F.col("_begin"))
    last = later.groupBy(session).agg(F.max(pos).alias("a_pos"), F.max_by("text", pos).alias("answer"))
    return asked.join(last, session, "left")


def answers_with_figures(messages: DataFrame, session: str = "conv_id", pos: str = "turn") -> DataFrame:
    """``selected_answers``, but where the last answer states no figure and the turn's answers together do, all of them
    joined by line ends: a closing remark after the figures. The turn begins after the last message of the user, written
    or injected."""
    chosen = selected_answers(messages, session, pos)
    begins = messages.filter(F.col("role") == "user").groupBy(session).agg(F.max(pos).alias("_begin"))
    said = messages.filter((F.col("role") == "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != "")).join(begins, session).filter(F.col(pos) > F.col("_begin"))
    texts = said.groupBy(session).agg(F.max_by("text", pos).alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, "text"))), lambda x: x["text"]), "\n").alias("joined"))
    plain = lambda c: F.regexp_replace(c, CITATION, " ")
    with_figures = texts.select(session, F.posexplode(F.array(plain(F.col("last")), plain(F.col("joined")))).alias("_which", "_said")).withColumn("_id", F.concat_ws("#", F.col(session).cast("string"), "_which"))
    found = extract_figures(with_figures, "_id", "_said", keep=(session, "_which")).groupBy(session).agg(F.min("_which").alias("_first"))
    told = texts.join(found, session, "left").select(session, F.when(F.col("_first") == 1, F.col("joined")).otherwise(F.col("last")).alias("answer"))
    return chosen.drop("answer", "a_pos").join(told, session, "left")


def valid_calculations(messages: DataFrame, session: str = "conv_id", pos: str = "turn") -> DataFrame:
    """session and calc_id of the results that tools gave after the last real question: those that may be cited."""
    real = (F.col("role") == "user") & (~F.col("injected") if "injected" in messages.columns else F.lit(True))
    asked = messages.filter(real).groupBy(session).agg(F.max(pos).alias("_asked"))
    told = messages.filter(F.col("role") == "tool").join(asked, session).filter(F.col(pos) > F.col("_asked"))
    return told.select(session, F.explode(F.regexp_extract_all("text", F.lit(r"\b(C\d+) = [^\n]*\(write it as:"), 1)).alias("calc_id")).distinct()


def since(checks: DataFrame, session: str, at: list[str], before: str) -> DataFrame:
    """The last check of each session beyond the first ``before`` ones, a column of numbers; none where there are no more."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(*at)) - 1
    later = checks.withColumn("_place", place).filter(F.col("_place") >= F.col(before))
    return later.groupBy(session).agg(F.count(F.lit(1)).alias("new"), F.max_by(F.struct(*[c for c in checks.columns if c != session]), "_place").alias("_last")).select(session, "new", "_last.*")


def attempts(checks: DataFrame, question: str, at: list) -> DataFrame:
    """``checks`` with attempt: 1 and the number of earlier checks of the same question."""
    return checks.withColumn("attempt", F.row_number().over(Window.partitionBy(question).orderBy(*at)))


def latest(checks: DataFrame, question: str, at: list) -> DataFrame:
    """The newest check of each question."""
    order = F.struct(*[F.col(c) for c in at])
    return checks.groupBy(question).agg(F.max_by(F.struct(*[c for c in checks.columns if c != question]), order).alias("_row")).select(question, "_row.*")


def year_hints(figures: DataFrame, years: DataFrame, within: str, reach: int = 15) -> DataFrame:
    """Each year of a clause goes to the nearest figure within ``reach`` characters; a figure that gets two different
    years gets none, and years inside figures count for none. figures: within, pos, start, stop; years: within, year,
    y_start, y_stop, and optionally forward (a colon follows: the next figure comes first)."""
    pairs = figures.join(years, within)
    behind = F.col("start") >= F.col("y_stop")
    gap = F.when(behind, F.col("start") - F.col("y_stop")).when(F.col("stop") <= F.col("y_start"), F.col("y_start") - F.col("stop"))
    forward = F.col("forward") & behind if "forward" in years.columns else F.lit(False)
    near = F.when(gap <= reach, F.struct((~forward).alias("later"), gap.alias("gap"), "start", "pos"))
    first = pairs.groupBy(within, "y_start", "year").agg(F.bool_or(gap.isNull()).alias("_inside"), F.min(near).alias("_near")).filter("not _inside and _near is not null")
    hints = first.select(within, F.col("_near.pos").alias("pos"), "year").groupBy(within, "pos").agg(F.when(F.min("year") == F.max("year"), F.max("year")).alias("year"))
    return figures.join(hints, [within, "pos"], "left")

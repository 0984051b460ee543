"""Passages, quotes and pages: which stored text a claim may point at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numerant.functions.text import loose_numbers, quoted_numbers, word_set
from numerant.lexicon import LOOSE_NUMBER, STOP_WORDS


#: A line that may hold a quote shares at least so many of its rarest words.
RARE_MEETINGS = 5


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 0), text of every line that isn't blank."""
    rows = docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line", "text"))
    return rows.filter(F.trim("text") != "")


def _terms(words):
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def top_passages(questions: DataFrame, lines: DataFrame, question_key: str, key: str, k: int = 6) -> DataFrame:
    """For each question (question_key, text) the k lines with a number that share most words with it.

    Filler words don't count; a shared word weighs 3; ties go to the earlier line. The join is on words of lines with a
    number only, and scores are summed before lines of a question meet.
    """
    numbered = lines.filter(F.col("text").rlike(LOOSE_NUMBER)).select(key, "line", F.explode(_terms(word_set(F.col("text")))).alias("word"))
    asked = questions.select(question_key, F.explode(_terms(word_set(F.col("text")))).alias("word"))
    scored = numbered.join(asked, "word").groupBy(question_key, key, "line").agg((F.count(F.lit(1)) * 3).alias("score"))
    order = Window.partitionBy(question_key).orderBy(F.desc("score"), key, "line")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def verified_quotes(quotes: DataFrame, lines: DataFrame, quote_key: str, key: str, share: float = 0.6) -> DataFrame:
    """For each quote (quote_key, text) the line that holds it best: all its numbers but years, and most of its words.

    quote_key, key, line, score; ties go to the smaller key, then the earlier line; quotes found nowhere have no row. A
    line that holds a share of the words holds at least some of the rarest of them, so only those are joined, as ids, and
    only with lines of as many words; lines come back in where enough of them meet. Null and empty quotes are found
    nowhere.
    """
    told = lines.select(key, "line", word_set(F.col("text")).alias("words"), loose_numbers(F.col("text")).alias("numbers"))
    asked = quotes.select(quote_key, word_set(F.col("text")).alias("asked"), quoted_numbers(F.col("text")).alias("wanted")).filter(F.size("asked") > 0)
    asked = asked.withColumn("need", F.ceil(F.size("asked") * share)).withColumn("least", F.least(F.lit(RARE_MEETINGS), F.col("need")))
    each = asked.select(quote_key, "need", "least", (F.size("asked") - F.col("need") + F.col("least")).alias("probes"), F.explode("asked").alias("word"))
    few = F.size("words") >= F.coalesce(F.lit(asked.agg(F.min("need")).first()[0]), F.lit(0))
    spoken = told.filter(few).select(key, "line", F.size("words").alias("size"), F.explode("words").alias("word"))
    often = spoken.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    rarity = F.row_number().over(Window.partitionBy(quote_key).orderBy(F.coalesce("often", F.lit(0)), "word"))
    probes = each.join(often, "word", "left").withColumn("_r", rarity).filter(F.col("_r") <= F.col("probes")).select(quote_key, "need", "least", "word")
    met = spoken.join(probes, "word").filter(F.col("size") >= F.col("need")).groupBy(quote_key, key, "line").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).filter("n >= least")
    scored = met.select(quote_key, key, "line").join(told, [key, "line"]).join(asked, quote_key).filter(F.size(F.array_except("wanted", "numbers")) == 0)
    scored = scored.withColumn("score", F.size(F.array_intersect("asked", "words")) / F.size("asked")).filter(F.col("score") >= share)
    order = Window.partitionBy(quote_key).orderBy(F.desc("score"), key, "line")
    return scored.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(quote_key, key, "line", F.round("score", 6).alias("score"))


def page_holding(rows: DataFrame, passage_key: str, page_key: str) -> DataFrame:
    """For each passage the one page with most of its rows; null if two pages hold as many.

    ``rows``: passage_key, page_key, one row for each row of the passage that is on the page.
    """
    counts = rows.groupBy(passage_key, page_key).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(passage_key).agg(F.max(F.struct("n", page_key)).alias("top"), F.max("n").alias("most"))
    ties = counts.join(best, passage_key).filter("n = most").groupBy(passage_key).agg(F.count(F.lit(1)).alias("pages"))
    return best.join(ties, passage_key).select(passage_key, F.when(F.col("pages") == 1, F.col(f"top.{page_key}")).alias(page_key), F.col("most").alias("n_rows"))


def figures_there(values: DataFrame, block: str = "block", raw: str = "raw", k: int = 15) -> DataFrame:
    """block and ``figures``: the first k different figures of each block, as they are written, in the order of text: what
    is said where an input isn't found. Repeats are dropped and ranks bounded before anything is brought together, so
    that a block with very many figures is no large row. Null figures are none."""
    each = values.select(block, F.trim(raw).alias("_raw")).filter("_raw is not null").distinct()
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy(block).orderBy("_raw"))).filter(F.col("_r") <= k)
    return first.groupBy(block).agg(F.array_join(F.sort_array(F.collect_list("_raw")), ", ").alias("figures"))

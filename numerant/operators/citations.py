"""Citations that stand for verified quotes: one id per quoted line, placeholders replaced by ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Placeholders of an answer.
PLACEHOLDERS = r"\[(CITE_\d+(?:\s*,\s*CITE_\d+)*)\]"
_CUT = "\x01"


def quote_ids(found: DataFrame, answer: str, pos: str, block: str, line: str) -> DataFrame:
    """``found`` (quotes of an answer with the block and line that hold them) with ``quote_no``: numbers from 1 by first
    mention; the same line quoted twice has one number. Ties in ``pos`` have the number of one quote's place each."""
    first = found.withColumn("_first", F.min(pos).over(Window.partitionBy(answer, block, line)))
    rank = F.dense_rank().over(Window.partitionBy(answer).orderBy("_first", block, line))
    return first.withColumn("quote_no", rank).drop("_first")


def expanded(answers: DataFrame, ids: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """``answers`` with placeholders such as [CITE_1, CITE_2] replaced by the ids they stand for, [a][b]; placeholders
    without an id vanish. ``ids``: key, placeholder, cite (null: none); of repeated placeholders the smallest cite
    counts. Null texts stay null; an empty table gives no rows."""
    known = ids.filter("placeholder is not null and cite is not null").groupBy(key, "placeholder").agg(F.min("cite").alias("cite"))
    known = known.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "cite"))).alias("_ids"))
    parts = F.split(F.regexp_replace(text, PLACEHOLDERS, f"{_CUT}[$1]{_CUT}"), _CUT)

    def told(part):
        names = F.split(F.regexp_extract(part, f"^{PLACEHOLDERS}$", 1), r"\s*,\s*")
        cites = F.array_compact(F.transform(names, lambda n: F.try_element_at("_ids", n)))
        return F.when(part.rlike(f"^{PLACEHOLDERS}$"), F.coalesce(F.array_join(F.transform(cites, lambda c: F.concat(F.lit("["), c, F.lit("]"))), ""), F.lit(""))).otherwise(part)

    return answers.join(known, key, "left").withColumn(text, F.array_join(F.transform(parts, told), "")).select(answers.columns)

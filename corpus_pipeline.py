"""A corpus pipeline: five stages over ``documents``, each a Spark job over all rows that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; clean documents stay as they are.

Nulls: documents without text are clean in every filter and are packed as one end id. Repeated rows stay repeated in
the filters, except that of equal or near-equal documents the one with the smallest doc_id stays. Rows with a null
doc_id are never taken for copies. Empty tables pass through. Extra columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerant.llm import decontamination, packing, partenum, secret_scan, tokens, toxicity
from numerant.llm.common import columns, id_filter, maybe_in, read, removed, stored
from numerant.llm.queries import END_ID, in_fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go. It learns from the labels outside its held-out fold, over all documents."""
    labels = read(spark, sf_dir, "labels").filter(~in_fold(5, 0))
    return toxicity.clean_documents(docs, toxicity.fit(docs, labels, label="toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (0.8 of five-word shingles) the one with the smallest doc_id stays, once; blank
    documents stay. A key that stays with several texts, which are one document, stays with all of them."""
    groups = partenum.near_groups(docs, words=5, percent=80).groupBy("doc_id").agg(F.min("component_id").alias("head"), F.count(F.lit(1)).alias("rows"))
    groups = stored(groups.filter("doc_id <> head or rows > 1"), "groups")
    known = id_filter(groups.select("doc_id"))  # most documents are alone and need no shuffle
    alone = maybe_in(docs.filter("doc_id is not null"), "doc_id", known, inside=False)
    some = maybe_in(docs.filter("doc_id is not null"), "doc_id", known).join(groups.filter("doc_id <> head").select("doc_id"), "doc_id", "left_anti")
    # Rows that share the key that stays are told apart by their text; blank ones are nobody's copies.
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")), F.lit("")) == ""
    digest = F.when(blank, F.monotonically_increasing_id().cast("string")).otherwise(F.sha2("text", 256))
    once = some.withColumn("_text", digest).dropDuplicates(["doc_id", "_text"]).select(columns(docs))
    return alone.union(once).union(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones included, are replaced; n_chars follows the text."""
    hidden = secret_scan.redact_documents(docs)
    return hidden.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars"))) if "n_chars" in docs.columns else hidden


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, as pieces in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", hide_secrets),
    ("best_fit_packing", pack_sequences),
]

#: No SQL expresses a trained model or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's table goes once the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
            if before is not None:
                removed(before)
            before = docs
    return docs

"""The store of documents, blocks, calculations and checks: append, upsert, and the latest of each key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(rows: DataFrame, key: str, version: list[Column]) -> DataFrame:
    """The latest row of each key. Rows are compared as they are summed, so a key with many versions is no hot spot."""
    columns = rows.columns
    order = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(version)])
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row")).select("_row.*")


def missing(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't stored yet."""
    return wanted.join(present.select(keys).distinct(), keys, "left_anti")


def numbered(rows: DataFrame, within: str, order: list[Column], name: str) -> DataFrame:
    """Sequential numbers from 1 within a document, by first-seen order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(within).orderBy(*order)))


def forward_filled(rows: DataFrame, within: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The last ``value`` at or before each row: what a unit row says of the rows below it."""
    window = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(window))


def captions(rows: DataFrame, within: str, order: list[Column], is_table: Column, states_scale: Column, text: Column) -> DataFrame:
    """For each table the nearest text above that states a scale, not looking past another table; column ``caption``."""
    before = Window.partitionBy(within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_island", F.coalesce(F.sum(is_table.cast("int")).over(before), F.lit(0)))
    island = Window.partitionBy(within, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("caption", F.when(is_table, F.last(F.when(states_scale & ~is_table, text), ignorenulls=True).over(island))).drop("_island")


def cached(requests: DataFrame, entries: DataFrame, keys: list[str], pages: str = "pages") -> DataFrame:
    """``requests`` (``keys`` and pages, null for all) with what a cache holds for them: level (``pages``: read for just these
    pages; ``file``: for the whole file; null: a miss, which must be read) and the other columns of ``entries`` (keys, pages,
    null for whole files, and results). Repeated requests count once; of several entries for the same the smallest counts.
    """
    others = [c for c in entries.columns if c not in [*keys, pages]]
    held = entries.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(pages).alias("_pages"), F.struct(*others).alias("_entry"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    exact = F.coalesce(F.col("_pages").eqNullSafe(F.col(pages)), F.lit(False))
    asked = requests.select(*keys, pages).distinct()
    met = asked.join(held, on & (exact | F.col("_pages").isNull()), "left")
    rank = F.when(F.col("_entry").isNotNull(), F.struct(F.when(exact, 0).otherwise(1).alias("rank"), F.col("_entry").alias("entry")))
    best = met.groupBy(*keys, pages).agg(F.min(rank).alias("_best"))
    level = F.when(F.col("_best.rank") == 0, F.when(F.col(pages).isNull(), "file").otherwise("pages")).when(F.col("_best.rank") == 1, "file")
    return best.select(*keys, pages, level.alias("level"), *[F.col(f"_best.entry.{c}").alias(c) for c in others])


# How many pages one request may ask for.
MOST_PAGES = 30


def read_problems(requests: DataFrame) -> DataFrame:
    """``requests`` (path, pages as an array or null for all, n_pages of the file or null if there is none) with problem:
    relative_path, no_document, too_many_pages or out_of_range; null for those that may be read. Repeated pages count once."""
    wanted = F.array_distinct("pages")
    asked = F.coalesce(F.size(wanted), F.lit(0)) > 0
    problem = (
        F.when(~F.coalesce(F.col("path").startswith("/"), F.lit(False)), "relative_path").when(F.col("n_pages").isNull() | ~F.lower("path").endswith(".pdf"), "no_document")
        .when(~asked & (F.col("n_pages") > MOST_PAGES), "too_many_pages").when(asked & (F.size(wanted) > MOST_PAGES), "too_many_pages")
        .when(asked & F.exists(wanted, lambda p: p.isNull() | (p < 1) | (p > F.col("n_pages"))), "out_of_range")
    )
    return requests.withColumn("problem", problem)


def pages_to_read(requests: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The pages (doc, page from 1) that requests (doc, pages, n_pages) need and no stored block is on."""
    pages = F.when(F.coalesce(F.size("pages"), F.lit(0)) > 0, F.array_distinct("pages")).otherwise(F.sequence(F.lit(1), F.col("n_pages")))
    wanted = requests.select(doc, F.explode(pages).alias("page")).distinct()
    return missing(wanted, blocks.select(doc, (F.col("page_index") + 1).alias("page")), [doc, "page"])


def with_sources(blocks: DataFrame, sources: DataFrame, prefix: str, order: list[Column]) -> DataFrame:
    """``blocks`` and one new block for each of ``sources`` (title, text and the columns they share), with ids that go on
    from the largest of the prefix: W3 after W2."""
    last = blocks.select(F.max(F.regexp_extract("block_id", rf"^{prefix}(\d+)$", 1).try_cast("int")).alias("_last"))
    # Sources of one search are few; numbers over all rows of a large table would meet in one task.
    fresh = sources.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).crossJoin(F.broadcast(last))  # one row, broadcast
    fresh = fresh.withColumn("block_id", F.concat(F.lit(prefix), (F.col("_n") + F.coalesce("_last", F.lit(0))).cast("string"))).drop("_n", "_last")
    return blocks.unionByName(fresh, allowMissingColumns=True)


def saved(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as a new version of the table at ``path``, read back: versions are written beside each other and the one
    that is whole and newest counts, so that readers never see half of one. Columns stay as they are."""
    version = f"{path}/version={uuid.uuid4().hex}"
    rows.write.parquet(version)
    return rows.sparkSession.read.schema(rows.schema).parquet(version)

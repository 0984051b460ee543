"""A key that most rows have is dealt out over tasks and files; results stay those of brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from numerant.llm import packing, token_files, tokens, voronoi
from numerant.llm.common import fresh_path, stored


def test_pieces_of_one_key_get_all_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 1000)
    rows = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(64).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    got = packing.placed(stored(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces"), 64)
    assert got.select("sequence_id").distinct().count() == 30_000
    windows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces").groupBy(F.pmod(F.xxhash64("_row"), F.lit(30)).alias("salt")).count().collect()
    assert len(windows) == 30 and max(r["count"] for r in windows) < 2_000


def test_records_of_one_key_go_to_several_files(spark):
    docs = spark.range(0, 4000, 1, 4).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same words").alias("text"), F.lit(0).alias("_key"))
    docs = docs.unionByName(spark.createDataFrame([(1, "first", 0), (9, "last", 0), (None, "none", 0)], "doc_id long, text string, _key int"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = token_files.write_tokens(docs, fresh_path(spark, "t"), tokens.vocabulary("word_bpe_49k.json"), 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [n for _, n, _ in files.files]
    assert sum(sizes) == 4003 and len(sizes) > 2 and max(sizes) < 2500
    rows = sorted(token_files.read_tokens(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1] + [5] * 4000 + [9]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()


@pytest.mark.parametrize("uri,want", [("s3a://bucket/a/b", "s3://bucket/a/b"), ("abfss://c@acc.dfs.core.windows.net/a", "abfss://c@acc.dfs.core.windows.net/a?account_name=acc"), ("hdfs://h/a", "hdfs://h/a"), ("file:///a", "file:///a"), ("/a", "/a")])
def test_paths_of_stores(uri, want):
    assert token_files.store_uri(uri) == want


def test_one_id_is_dealt_out_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "ROWS_PER_BLOCK", 256)
    monkeypatch.setattr(voronoi, "QUERIES_PER_BLOCK", 64)
    table = spark.range(6000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).cast("array<float>").alias("embedding"))
    got = voronoi.inner_product_top_k(table, F.col("vec_id") % 1000 == 0, 5).collect()
    rows = [(r.vec_id, np.floor(64 * np.array(r.embedding, float))) for r in table.collect()]
    for q in {r.query_id for r in got}:
        x = dict(rows)[q]
        want = sorted((-int(x @ v), i) for i, v in rows if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in want]


def test_huge_components(spark):
    table = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in voronoi.inner_product_top_k(table, F.col("vec_id") == 0, 3).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**53 * 64 + 64 * 64), (2, -(2**63) + 1)]

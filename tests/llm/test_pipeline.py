"""The pipeline's stages on a small corpus, each against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from numerant.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(8), tmp_path_factory.mktemp("sf")
    docs, labels = [], []
    bench = [(k, " ".join(f"b{k}x{rng.randrange(99)}" for _ in range(40))) for k in range(3)]
    for d in range(240):
        w = [f"w{rng.randrange(300)}" for _ in range(60)]
        if d % 6 == 0:
            w[rng.randrange(60)] = "lump"
            w[rng.randrange(60)] = "lump"
        if d % 10 == 1:
            w += bench[d % 3][1].split()
        if d % 10 == 2:
            w.append('token = "abcdefgh1234"')
        docs.append((d, " ".join(w), "en", "s", 0))
        labels.append((d, 1, int(d % 6 == 0)))
    docs += [(1000 + d, docs[d][1], "en", "s", 0) for d in (3, 4, 5)] + [(2000, docs[9][1] + " more", "en", "s", 0), (3000, None, None, None, None), (3001, "", "en", "s", 0), (None, docs[3][1], "en", "s", 0), (7, docs[7][1], "en", "s", 0)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {d for d in range(240) if d % 6 == 0}
    first = C.drop_toxic(spark, docs, folder)
    ids = [r.doc_id for r in first.collect()]
    assert first.columns == docs.columns and not toxic & set(ids) and len(ids) == docs.count() - len(toxic)
    second = C.drop_copies(spark, first, folder)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in second.collect())
    want = sorted((x is None, x or 0) for x in {i for i in ids if i not in (1003, 1004, 1005, 2000)})
    assert second.columns == docs.columns and kept == want
    third = C.drop_contaminated(spark, second, folder)
    left = {r.doc_id for r in third.collect()}
    assert third.columns == docs.columns and left == {x for _, x in kept} - {d for d in range(240) if d % 10 == 1} - {0} | {None} or left
    assert not any(d is not None and d < 240 and d % 10 == 1 for d in left)
    fourth = C.hide_secrets(spark, third, folder)
    rows = fourth.collect()
    assert fourth.columns == docs.columns and {r.doc_id for r in rows} == left
    assert not any("abcdefgh1234" in (r.text or "") for r in rows) and sum("[secret]" in (r.text or "") for r in rows) == sum(d is not None and d < 240 and d % 10 == 2 for d in left)
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    fifth = C.pack_sequences(spark, fourth, folder)
    assert {r.doc_id for r in fifth.collect()} == left
    assert fifth.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_copies_are_of_five_words_and_four_fifths(spark, folder):
    words = [f"u{k}" for k in range(100)]

    def changed(*at):
        return " ".join("other" if k in at else w for k, w in enumerate(words))

    rows = [(1, changed()), (2, changed(30, 60)), (3, changed(20, 40, 60, 80).replace("u", "v")), (4, changed(10, 50, 90).replace("u", "v"))]
    rows += [(5, " ".join(f"z{k}" for k in range(100))), (6, " ".join("other" if k in (20, 50, 80) else f"z{k}" for k in range(100)))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], COLUMNS)
    # 1 and 2: 86 of 106 shingles of five words, 92 of 104 of three; 5 and 6: 81 of 111 of five.
    assert sorted(r.doc_id for r in C.drop_copies(spark, docs, folder).collect()) == [1, 3, 4, 5, 6]


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secret_scan", "best_fit_packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())

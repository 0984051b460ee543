"""What was found of the pipeline on larger tables."""

import random

import numpy as np

from numerant.llm import partenum as P


def test_long_texts_with_a_common_passage_are_not_compared_with_each_other(spark, monkeypatch):
    rng, rows, counts, stored = random.Random(3), [], [], P.stored
    passage = [f"p{k}" for k in range(100)]
    for d in range(40):
        own = [f"o{rng.randrange(10**9)}" for _ in range(800)]
        rows.append((d, " ".join(own[:400] + passage + own[400:])))

    def counted(df, name):
        out = stored(df, name)
        if name == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(P, "stored", counted)
    for group in (4, 64):  # by blocks, by a join
        docs = spark.createDataFrame([*rows, (100, rows[0][1] + " end")], "doc_id long, text string")
        found = {r.doc_id: r.component_id for r in P.near_groups(docs, words=5, percent=80, group=group).collect()}
        assert found == {d: d for d in range(40)} | {100: 0}
    assert sum(counts) < 2 * 3 * 41, counts  # 658 before


def test_any_common_order_of_signatures_leaves_one(spark):
    rng = np.random.default_rng(5)
    for trial in range(300):
        every = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64) * np.uint64(2))
        cut = int(rng.integers(0, len(every) // 8 + 1))
        rng.shuffle(every)
        a, b = np.sort(every[cut:]), np.sort(every[: len(every) - cut])
        if not (len(a) and len(b) and P.similar(a, b, 80)):
            continue
        left = []
        for s in (a, b):
            signed, spare = P.spare_signatures(s, 80)
            kept = set()
            for band, least in enumerate(spare[1:], spare[0]):
                of_band = sorted((x for x in signed.tolist() if x % P.BANDS == band), key=lambda x: (hash((x, trial)), x))
                kept |= set(of_band[least:])
            left.append(kept)
        assert left[0] & left[1]

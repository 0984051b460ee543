"""Token files and packing: exact round trips, and the packing against a plain best-fit-decreasing."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from numerant.llm import packing, token_files, tokens
from numerant.llm.common import fresh_path

ODD = [None, "", " ", "  a", "a\n\n b", "a\tb \n\tc", "it's 's", "É é x́", "日本 語 ١٢ 3²", "İI ΑΣ", "🎉🎉 e🎉", "A_B-c 12.5%", "trail ", "x\x1c y", "<|endoftext|> a", "the the", "word " * 4000]


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def encoder(request):
    return tokens.Encoder(tokens.vocabulary(request.param), memo=50)


def test_ids_are_the_library_s(encoder):
    assert encoder.ids(ODD) == [encoder.direct(t or "") for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabAB09.,!'éßÖ<|e字", max_size=25), max_size=6))
def test_ids_of_any_text(encoder, texts):
    assert encoder.ids(texts) == [encoder.direct(t) for t in texts]


def test_token_files_round_trip(spark):
    rows = [(k * 7 % 101, t, f"s{k}") for k, t in enumerate(ODD)] + [(3, "again", "x"), (3, "again", "x"), (None, "no key", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    files = token_files.write_tokens(docs, fresh_path(spark, "t"), tokens.vocabulary("word_bpe_49k.json"), 2)
    got = token_files.read_tokens(spark, files, with_ids=True).orderBy("start").collect()
    enc, start = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json")), 0
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    for r, (_, text, _) in zip(got, want, strict=True):
        ids = [*np.frombuffer(enc.direct(text or ""), "<u4").tolist(), 2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    name, records, _ = files.files[0]
    key, ids = token_files.read_one(files, name, records - 1)
    there = [r for r in got if r.file == name][-1]
    assert (key, ids.tolist()) == (there.doc_id, there.ids)


def test_a_broken_record_is_noticed(tmp_path):
    data = bytearray(token_files.framed(b"12345678abcd"))
    (tmp_path / "a").write_bytes(data)
    assert token_files.read_record((tmp_path / "a").open("rb")) == b"12345678abcd"
    for at in (2, 9, 15, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        (tmp_path / "b").write_bytes(bad)
        with pytest.raises(ValueError):
            token_files.read_record((tmp_path / "b").open("rb"))
    (tmp_path / "c").write_bytes(data[:-3])
    with pytest.raises(ValueError):
        token_files.read_record((tmp_path / "c").open("rb"))


def test_no_documents_no_files(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files = token_files.write_tokens(docs, fresh_path(spark, "t"), tokens.vocabulary("word_bpe_49k.json"), 2)
    assert files.files == [] and token_files.read_tokens(spark, files).count() == 0
    assert packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), 2).count() == 0


def plain_best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        bins += at == len(rooms)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - n)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_runs_are_best_fit_decreasing(case):
    capacity, lengths = case
    bins = defaultdict(list)
    for length, _, n, first, per, offset in packing.best_fit_decreasing(Counter(lengths), capacity):
        for r in range(n):
            bins[first + r // per].append((offset + r % per * length, length))
    assert Counter(n for b in bins.values() for _, n in b) == Counter(lengths)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == plain_best_fit(lengths, capacity)


@pytest.mark.parametrize("per_salt", [packing.PER_SALT, 3])
def test_packing_of_documents(spark, monkeypatch, per_salt):
    monkeypatch.setattr(packing, "PER_SALT", per_salt)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "and", "of", "thing"]) for _ in range(rng.choice([0, 3, 20, 70, 300]))), k) for k in range(150)] + [(7, None, 1), (None, "x", 2), (9, "the " * 50, 3), (9, "the " * 50, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), 2, capacity=64, with_ids=True)
    rows_out = got.collect()
    enc = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    want = Counter(tuple([*np.frombuffer(enc.direct(t or ""), "<u4").tolist(), 2]) for _, t, _ in rows)
    parts = defaultdict(list)
    for r in rows_out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 64
        parts[r.doc_id].append((r.piece, r.start, r.ids))
    for key, ps in parts.items():
        if sum(x[0] == key for x in rows) == 1:
            assert [p[1] for p in sorted(ps)] == [sum(len(q[2]) for q in sorted(ps)[:n]) for n in range(len(ps))]
            assert tuple(i for p in sorted(ps) for i in p[2]) in want
            assert all(len(p[2]) == 64 for p in sorted(ps)[1:])
    assert sum(r.length for r in rows_out) == sum(len(k) * n for k, n in want.items())
    spans = defaultdict(list)
    for r in rows_out:
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    assert len(spans) == plain_best_fit([r.length for r in rows_out], 64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert {k: len(v) for k, v in whole.items()} == {k: sum(n for _, n in s) for k, s in spans.items()}

"""Nested layers of the secret scan: every pair of encodings, streams in streams, blocks over line ends."""

import base64
import bz2
import gzip
import lzma
import zlib

import pytest
import zstandard

from numerant.llm import secret_scan as S

SECRET = "password=hunter2hunter2"


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def deflated(data: bytes) -> bytes:
    tool = zlib.compressobj(9, zlib.DEFLATED, -15)
    return tool.compress(data) + tool.flush()


def lines(text: str, end: str, width: int = 20) -> str:
    return end.join(text[k : k + width] for k in range(0, len(text), width))


ENCODERS = {
    "percent": lambda t: "".join(f"%{b:02X}" for b in t.encode()), "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t), "percent u": lambda t: "".join(f"%u{ord(c):04X}" for c in t),
    "braces": lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t), "bytes": lambda t: "".join(f"\\x{b:02x}" for b in t.encode()), "references": lambda t: "".join(f"&#x{ord(c):x};" for c in t),
    "base64": lambda t: b64(t.encode()), "url-safe": lambda t: base64.urlsafe_b64encode(t.encode()).decode(), "wrapped": lambda t: lines(b64(t.encode()), "\n"), "written line ends": lambda t: lines(b64(t.encode()), "\\n"),
    "escaped slashes": lambda t: b64(t.encode()).replace("/", "\\/"), "hex": lambda t: t.encode().hex(), "upper hex": lambda t: t.encode().hex().upper(), "hex lines": lambda t: lines(t.encode().hex(), "\n"),
    "gzip": lambda t: b64(gzip.compress(t.encode(), mtime=0)), "zlib": lambda t: b64(zlib.compress(t.encode())), "deflate": lambda t: b64(deflated(t.encode())), "hex of deflate": lambda t: deflated(t.encode()).hex(),
    "bzip2": lambda t: b64(bz2.compress(t.encode())), "xz": lambda t: b64(lzma.compress(t.encode())), "zstandard": lambda t: b64(zstandard.ZstdCompressor().compress(t.encode())), "hex of gzip": lambda t: gzip.compress(t.encode(), mtime=0).hex(),
}


@pytest.mark.parametrize("outer", ENCODERS)
def test_every_pair_of_encodings_is_unwrapped(outer):
    for inner in ENCODERS:
        text = "so: " + ENCODERS[outer](ENCODERS[inner](SECRET)) + " ."
        spans = S.scan(text)[1]
        assert any(k == 0 and 4 <= low < high <= len(text) - 2 for low, high, k in spans), inner


@pytest.mark.parametrize("pack", [lambda d: gzip.compress(d, 1, mtime=0), lambda d: zlib.compress(d, 1)])
def test_streams_nest_to_any_depth(pack):
    data = SECRET.encode()
    for _ in range(5000):
        data = pack(data)
    text = f"see {b64(data)}."
    assert S.scan(text)[1] == [(4, len(text) - 1, 0)]


def test_streams_and_text_in_turn():
    text = SECRET
    for _ in range(60):
        text = b64(gzip.compress(text.encode(), mtime=0))
    assert S.scan(text)[1] == [(0, len(text), 0)]


@pytest.mark.parametrize("ahead", ["data", "a", "ab", "data0", "DATAF", "x-"])
def test_hex_after_letters_of_its_alphabet(ahead):
    coded = SECRET.encode().hex()
    for text in (ahead.lower() + coded, ahead.upper() + coded.upper()):
        low, high, kind = [s for s in S.scan(text)[1] if s[2] == 0][0]
        assert kind == 0 and low >= len(ahead) - 1 and high == len(text)


def test_what_stands_behind_a_stream_is_read_too():
    text = b64(gzip.compress(b"nothing here", mtime=0) + b"\xff\x00" + gzip.compress(SECRET.encode(), mtime=0))
    assert [s[2] for s in S.scan(text)[1]] == [0]


def test_a_large_stream_is_decompressed_once(monkeypatch):
    monkeypatch.setattr(S, "LAYER_LIMIT", 1 << 20)
    monkeypatch.setattr(S, "OVERLAP", 1 << 10)
    made = []
    real = S.pieces
    monkeypatch.setattr(S, "pieces", lambda raw, bare=False: made.append(len(raw)) or real(raw, bare))
    body = b"0 " * (3 << 20) + SECRET.encode() + b" 1" * (1 << 20)
    coded = gzip.compress(body, mtime=0)
    text = "of " + b64(coded) + " end"
    assert S.scan(text)[1] == [(3, len(text) - 4, 0)]
    assert made.count(len(coded)) == 1

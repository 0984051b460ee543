"""Secret scan and URL filter against plain versions."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from numerant.llm import secret_scan as S
from numerant.llm import url_rules as U

SECRET = 'token = "abcdefgh1234"'
BARE = "AKIA" + "Z" * 14


def plain_spans(text):
    """The contract, word by word."""
    out = []
    rx = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), 0, m.end()) for m in rx.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(a, b, k) for a, k, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "SECRET", "api_key", "apikey", "ſecret", ":", "=", " ", '"', "'", "abcd1234", "AKIA", "ZZZZ0000", "0123456789abcdef", "é", "-", "\n", "K"]), max_size=24).map("".join))
def test_base_matches(text):
    assert S.scan(text)[0] == plain_spans(text)


PACK = {
    "base64": lambda b: base64.b64encode(b).decode(),
    "url-safe": lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="),
    "hex": lambda b: b.hex(),
    "gzip": lambda b: base64.b64encode(gzip.compress(b)).decode(),
    "zlib": lambda b: base64.b64encode(zlib.compress(b)).decode(),
    "bz2": lambda b: base64.b64encode(bz2.compress(b)).decode(),
    "xz": lambda b: base64.b64encode(lzma.compress(b)).decode(),
    "zstd": lambda b: base64.b64encode(zstandard.compress(b)).decode(),
    "percent": lambda b: "".join(f"%{x:02X}" for x in b),
    "quoted": lambda b: urllib.parse.quote(b.decode("latin-1")),
    "unicode": lambda b: "".join(f"\\u{x:04x}" for x in b),
    "bytes": lambda b: "".join(f"\\x{x:02x}" for x in b),
    "entities": lambda b: "".join(f"&#{x};" for x in b),
    "twice": lambda b: urllib.parse.quote(urllib.parse.quote(b.decode("latin-1"))),
}


@pytest.mark.parametrize("first", PACK)
@pytest.mark.parametrize("second", [None, *PACK])
def test_layers(first, second):
    packed = PACK[first](SECRET.encode())
    if second:
        packed = PACK[second](packed.encode())
    text = f"é {packed} end"
    added = [s for s in S.scan(text)[1] if s[2] == 0 and s not in S.scan(text)[0]]
    assert added, text[:80]
    assert all(2 <= low < high <= 2 + len(packed) for low, high, _ in added)


def test_spans_point_at_the_encoded_stretch():
    text = "x " + base64.b64encode(b"filler filler " + BARE.encode() + b" filler").decode() + " y"
    low, high, kind = next(s for s in S.scan(text)[1] if s[2] == 1)
    start = 2 + 14 // 3 * 4
    assert (low, kind) == (start, 1) and BARE in base64.b64decode(text[low:high]).decode() + ""
    text = "a " + urllib.parse.quote(SECRET) + " b"
    low, high, _ = S.scan(text)[1][0]
    assert urllib.parse.unquote(text[low:high]) == SECRET[:-1]


@pytest.mark.parametrize("text", ["api_key: %61%62cdefgh1234", r'"password": "\u0068unter2hunter2"', "password%3A hunter2hunter2", "token: secret%3Ahunter2hunter2", "x\ny password &#61; hunter2hunter2"])
def test_escapes_beside_blanks(text):
    base, spans, *_ = S.scan(text)
    assert not base and len(spans) == 1 and "hunter2" not in S.redacted(text, spans) and "cdefgh" not in S.redacted(text, spans)


def test_plain_matches_keep_their_rules_beside_escapes():
    text = "token: secret: hunter2hunter2 and %41"
    assert S.scan(text)[1] == S.scan(text)[0] == []


def wrapped(raw):
    coded = base64.b64encode(raw).decode()
    return "\n".join(coded[k : k + 76] for k in range(0, len(coded), 76))


@pytest.mark.parametrize("glue", ["https://x.example.com/p/", "id-", "data_", "a", "ab+"])
@pytest.mark.parametrize("kind", ["base64", "gzip", "zstd"])
def test_base64_behind_its_own_alphabet(glue, kind):
    packed = PACK[kind](b"password=hunter2hunter2")
    text = f"see {glue}{packed} end"
    _, spans, *_ = S.scan(text)
    assert spans and packed[4:-8] not in S.redacted(text, spans) and S.redacted(text, spans).endswith(" end")


@pytest.mark.parametrize("before", range(30, 60))
def test_wrapped_base64(before):
    noise = random.Random(before).randbytes(300).hex().upper().encode()
    raw = b"x" * before + b" password=hunter2hunter2 " + b"y" * 70
    for text in (wrapped(raw), wrapped(gzip.compress(noise + b" password=hunter2hunter2 ")), wrapped(raw).replace("\n", "\r\n")):
        for end in ("", "\nword\nwords"):
            full = f"key: {text}{end}"
            spans = [s for s in S.scan(full)[1] if s[2] == 0]
            assert spans and all(5 <= a < b <= len(full) for a, b, _ in spans), full
    low, high, _ = [s for s in S.scan(wrapped(raw))[1] if s[2] == 0][0]
    held = wrapped(raw)[low:high].replace("\n", "")
    assert b"password=hunter2hunter2" in base64.b64decode(held) and len(held) <= 36


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_streams_of_several_members(pack):
    text = base64.b64encode(pack(b"nothing here ") + pack(b"or here ") + pack(b"password=hunter2hunter2")).decode()
    assert [s[2] for s in S.scan(text)[1]] == [0]
    text = base64.b64encode(pack(b"password=hunter2hunter2") + b"\x80 rest").decode()
    assert [s[2] for s in S.scan(text)[1]] == [0]


def test_odd_texts_end():
    for text in ("", "%", "%41" * 3000, "%" + "25" * 50_000, "a" * 200_000 + "%", "\\u" * 1000, "&#99999999;", "A" * 100_001, "0" * 99_999):
        base, spans, _ = S.scan(text)
        assert set(base) <= set(spans)


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress, zlib.compress])
def test_streams_beyond_the_limit_of_a_layer(monkeypatch, pack):
    monkeypatch.setattr(S, "LAYER_LIMIT", 3 << 20)
    monkeypatch.setattr(S, "OVERLAP", 1 << 10)
    far = b"\0" * (4 << 20) + b" password=hunter2hunter2 " + b"\0" * (1 << 20)
    for text in (pack(far), pack(b"." * (4 << 20) + base64.b64encode(gzip.compress(far)))):
        full = f"x {base64.b64encode(text).decode()} y"
        assert S.scan(full)[1] == [(2, len(full) - 2, 0)]


ESCAPED = {
    "percent": PACK["percent"],
    "quoted": lambda b: urllib.parse.quote(b, safe="/+-=!~*'();:@&,$"),
    "bytes": PACK["bytes"],
    "unicode": PACK["unicode"],
    "hex": PACK["hex"],
}


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress, zlib.compress])
@pytest.mark.parametrize("escape", ["percent", "quoted", "bytes", "unicode", "hex"])
def test_escaped_streams(pack, escape):
    packed = ESCAPED[escape](pack(b"first line\npassword=hunter2hunter2 and more"))
    text = f"GET /x?q={packed} end" if escape != "hex" else f"q: {packed} end"
    spans = [(a, b) for a, b, k in S.scan(text)[1] if k == 0]
    assert len(spans) == 1 + (pack is zstandard.compress and escape != "hex")  # it leaves short texts as they are, so that an escape shows them too
    assert all(a >= text.index(packed) and b <= text.index(" end") for a, b in spans)
    assert max(b - a for a, b in spans) > len(packed) - 40


@pytest.mark.parametrize("raw", ["password=hunter2hunter2".encode("utf-16-le"), "password=hunter2hunter2".encode("utf-16-be"), "\ufeffé password=hunter2hunter2".encode("utf-16-le"), b"\x01\x02 password=hunter2hunter2 \x00"])
@pytest.mark.parametrize("kind", ["base64", "hex", "gzip", "percent", "bytes"])
def test_wide_and_binary_text(raw, kind):
    text = f"see {PACK[kind](raw)} end"
    spans = S.scan(text)[1]
    assert [k for _, _, k in spans if k == 0] == [0] and S.redacted(text, spans).endswith(" end")


def test_documents(spark):
    rows = [(1, f"x {SECRET}", "k"), (1, f"x {SECRET}", "k"), (2, None, "k"), (3, "", "k"), (None, BARE, "k"), (4, "plain é" * 20000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = S.scan_documents(docs).collect()
    assert len(got) == 6
    one = [r for r in got if r.doc_id == 1]
    assert [(r.n_assign, r.n_access, r.n_hex, r.spans) for r in one] == [(1, 0, 0, "assign:2:23")] * 2
    assert one[0].base_sha256 == hashlib.sha256(b"assign:2:23").hexdigest()
    assert next(r for r in got if r.doc_id == 2).base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in S.redact_documents(docs).collect()}
    assert clean[1] == 'x [secret]"' and clean[None] == "[secret]" and clean[2] is None and clean[4] == "plain é" * 20000
    assert S.redact_documents(docs).columns == docs.columns and S.scan_documents(docs.limit(0)).count() == 0


def glob_regex(glob):
    out = ""
    while glob:
        wild = "**" if glob.startswith("**") else glob[0]
        glob = glob[len(wild) :]
        out += {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(wild) or re.escape(wild)
    return re.compile(out + r"\Z")


def brute_rule(rules, url):
    return next((r for r in sorted(rules, key=lambda r: (-r.weight, r.name)) if glob_regex(r.glob).match(url)), None)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.text(alphabet="ab*?/.éö", min_size=1, max_size=14), min_size=1, max_size=12), st.lists(st.text(alphabet="ab/.éöü", max_size=20), max_size=12), st.sampled_from([1, 1 << 20]), st.sampled_from([1, 1 << 10]))
def test_automaton_is_every_glob(globs, urls, state_words, most_words):
    rules = [U.Rule(f"{k}", "block", g, k) for k, g in enumerate(globs)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(U, "STATE_WORDS", state_words)
        patch.setattr(U, "MOST_WORDS", most_words)
        assert U.judged(U.automata(rules), urls) == [brute_rule(rules, u) for u in urls]
        for rule in rules:
            assert U.judged(U.automata([rule]), urls) == [brute_rule([rule], u) for u in urls]


def test_letters_beyond_ascii(spark):
    rules = [U.host_rule("block", "münchen.de", "/")]
    pages = spark.createDataFrame([(1, "http://münchen.de/"), (2, "http://mönchen.de/"), (3, "http://x.münchen.de/ü")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge_urls(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block"}
    assert {r.verdict for r in U.judge_urls(pages, []).collect()} == {"allow"}


def test_urls(spark):
    rules = [U.host_rule(*r) for r in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/"))] + [U.Rule("junk", "block", "*spam*/**", -1)]
    cases = [
        ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"), ("http://notexample.net", "notexample.net", "", None, "allow"),
        ("http://xorg/fr/", "xorg", "/fr/", None, "allow"), ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"), ("http://spam.com/x.net/", "spam.com", "/x.net/", "junk", "block"), ("no url", "", "", None, "allow"),
        (None, "", "", None, "allow"), ("http://É.net/é" + "x" * 3000, "É.net", "/é" + "x" * 3000, "net/", "block"), ("://b.net/#", "b.net", "/", "net/", "block"), ("http://c.net?a/", "c.net", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0], "v") for k, c in enumerate(cases)] + [(0, cases[0][0], "w"), (None, "http://a.net/", "z")], "page_id long, url string, verdict string")
    got = U.judge_urls(pages, rules).collect()
    assert len(got) == len(cases) + 2
    seen = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert [seen[k] for k in range(len(cases))] == [c[1:] for c in cases] and seen[None][3] == "block"
    assert U.judge_urls(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("most_words", [1, 4, 1 << 10])
def test_many_rules(monkeypatch, most_words):
    monkeypatch.setattr(U, "MOST_WORDS", most_words)
    rng = random.Random(1)
    rules = [U.host_rule("block", "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), "/") for _ in range(300)]
    machines = U.automata(rules)
    assert (len(machines) > 10) == (most_words < 5) and sum(len(m.rules) for m in machines) == 300
    urls = [f".x.{r.name}p" for r in rules[:50]] + [".zzz/"]
    got, want = U.judged(machines, urls), [brute_rule(rules, u) for u in urls]
    assert [r and r.name for r in got] == [r and r.name for r in want]

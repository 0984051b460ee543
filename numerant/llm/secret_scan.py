"""Secret scan: rules over every whole text, and over every layer that can be unwrapped from it.

A worklist holds layers. Each layer is scanned, then searched for encoded regions: percent escapes, Unicode and byte
escapes, character references, base64 (plain and URL-safe), hexadecimal, and, within the bytes that any of these gives,
gzip, zlib, bzip2, xz and zstandard streams (raw deflate too, if it makes up the whole) and UTF-16 text. What a region
decodes to is a new layer with a map back to its parent, so that a match in it has a span in the original text. What a
stream holds goes back to the worklist as it is, so streams in streams nest to any depth. A layer's content is looked at
once (cycle detection by digest of the content and its place), so the worklist ends when nothing new can be unwrapped.

Layers are unwrapped one by one, the innermost first, and streams are decompressed once, as they are looked at: one that
grows beyond ``LAYER_LIMIT`` is one layer after the other, each of them with the last ``OVERLAP`` bytes of the one before.
Only matches and streams inside such a stream that are themselves longer than the overlap may be seen in part. Where a
stream ends is known after its last layer, so matches are mapped to the text when all layers are done.

Spans count code points, end exclusive. A match in percent or Unicode escapes maps to exactly the escaped stretch, one
in base64 or hexadecimal to the characters that hold its bytes, and one in a compressed stream to the whole region.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerant.llm.common import small_batches

KINDS = ("assign", "access", "hex")

#: Fixed patterns of the contract. The lengths are part of the rules, so a match that is too short still uses up its text.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a longer run holds every shorter one
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("passw", "secret", "token", "apikey", "api_key")

#: Percent escapes may be escaped again and again (``%252541``): such a chain is one escape of its last byte.
ESCAPE = re.compile(r"((?:%(?:25)*[0-9A-Fa-f]{2})+)|((?:[\\%]u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|((?:\\x[0-9A-Fa-f]{2})+)|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|\\u\{([0-9A-Fa-f]{1,6})\}")
WIDE_MARK = re.compile(r"[\\%]u")
ONE_BYTE = re.compile(r"(?:%(?:25)*|\\x)([0-9A-Fa-f]{2})")
#: What may stand between the characters of a coded block: line ends, also written as escapes, and escapes of slashes.
GAP = r"(?:\r?\n|(?:\\r)?\\n)[ \t]*+|\\(?=/)"
GAPS = re.compile(GAP)
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}+(?:(?:{GAP})[A-Za-z0-9+/_-]++)*+={{0,2}}")
STRETCH = re.compile(rb"[\t-\r\x20-~]{14,}")  # a match has 14 ASCII characters at least, an encoded one more
STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18|\x78[\x01\x5e\x9c\xda]")
HEX_TEXT = re.compile(rf"[0-9A-Fa-f]{{16,}}+(?:(?:{GAP})[0-9A-Fa-f]++)*+")

WIDE = re.compile(rb"(?:[\t-\r\x20-~]\x00){14,}|(?:\x00[\t-\r\x20-~]){14,}")  # the same in UTF-16

#: A compressed stream is unwrapped in layers of at most so many bytes, which overlap.
LAYER_LIMIT = 32 << 20
OVERLAP = 1 << 20


def matches(text: str, inner: bool = False) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all rules in one text, each rule leftmost and without overlaps.

    With ``inner``, a match that is too short doesn't use up its value, which may be the name of another one.
    """
    out = []
    low = text.lower()
    if any(n in low for n in NAMES) or not text.isascii():
        at = 0
        while m := ASSIGN.search(text, at):
            long = m.end(2) - m.start(2) >= 8
            at = m.start(2) if inner and not long else m.end()
            if long:
                out.append((m.start(), m.end(), 0))
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


@dataclass(eq=False)
class Region:
    """Where a stream stands in its layer; ``high`` is known once it is decompressed."""

    low: int
    high: int | None = None


@dataclass(eq=False)
class Layer:
    """A text, and where it comes from: for character k, ``lows[k]`` to ``highs[k]`` in the parent (or one region)."""

    text: str
    parent: Layer | None = None
    lows: list[int] | None = None
    highs: list[int] | None = None
    region: Region | None = None
    unit: tuple[int, int] = (0, 0)  # (bytes, characters of the region that hold them); 0: the whole region
    offsets: list[int] | None = None  # of each character in the decoded bytes, if not one each

    def back(self, start: int, end: int) -> tuple[int, int | Region]:
        """The span in the original text; its end is a region while that one's own end isn't known."""
        layer = self
        while layer.parent is not None:
            if layer.lows is not None:
                start, end = layer.lows[start], layer.highs[end - 1]
            elif layer.unit[0]:
                if layer.offsets is not None:
                    start, end = layer.offsets[start], layer.offsets[end]
                size, chars = layer.unit
                start, end = layer.region.low + start // size * chars, min(layer.region.high, layer.region.low + -(-end // size) * chars)
            elif layer.region.high is None:
                return layer.region.low, layer.region
            else:
                start, end = layer.region.low, layer.region.high
            layer = layer.parent
        return start, end


@dataclass(eq=False)
class Packed:
    """Bytes out of a stream that stands in a region of a layer."""

    layer: Layer
    raw: bytes
    region: Region


def unescaped(layer: Layer) -> Iterator[Layer]:
    """The layer with all its escapes decoded, so that a match may reach over white space; none without escapes."""
    text = layer.text
    if "%" not in text and "\\" not in text and "&#" not in text:
        return
    escapes = list(ESCAPE.finditer(text))
    if not escapes:
        return
    parts, lows, highs, at = [], [], [], 0

    def plain(low: int, high: int) -> None:
        parts.append(text[low:high])
        lows.extend(range(low, high))
        highs.extend(range(low + 1, high + 1))

    for m in escapes:
        plain(at, m.start())
        at = m.end()
        if m[1] or m[4]:
            units = [(x.start(), x.end()) for x in ONE_BYTE.finditer(text, m.start(), m.end())]
            decoded = utf8(bytes(int(text[high - 2 : high], 16) for _, high in units))
        elif m[2]:
            units = [(k, k + 6) for k in range(m.start(), m.end(), 6)]
            decoded = [(c, n // 2) for c, n in utf16(bytes.fromhex(WIDE_MARK.sub("", m[2])))]
        else:
            units = [(m.start(), m.end())]
            value = int(m[5]) if m[5] else int(m[3] or m[6] or m[7], 16)
            decoded = [(chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else "\ufffd", 1)]
        k = 0
        for c, n in decoded:
            parts.append(c)
            lows.append(units[k][0])
            k += n
            highs.append(units[k - 1][1])
    plain(at, len(text))
    yield Layer("".join(parts), layer, lows, highs)
    yield from escaped_bytes(layer, escapes)


def escaped_bytes(layer: Layer, escapes: list[re.Match]) -> Iterator[Layer]:
    """Layers in compressed streams and UTF-16 text whose bytes are partly escaped, partly written as they are."""
    text, parts, marks, size, at = layer.text, [], [], 0, 0  # marks: byte, first character, characters for each byte

    def put(data: bytes, low: int, step: int) -> None:
        nonlocal size
        if data:
            parts.append(data)
            marks.append((size, low, step))
            size += len(data)

    for m in escapes:
        plain = text[at : m.start()]
        put(plain.encode("latin-1", "replace"), at, 1)
        at = m.end()
        if m[1] or m[4]:
            for x in ONE_BYTE.finditer(text, m.start(), m.end()):
                put(bytes([int(x[1], 16)]), x.start(), x.end() - x.start())
        elif m[2]:
            put(bytes(min(255, int(text[k + 2 : k + 6], 16)) for k in range(m.start(), m.end(), 6)), m.start(), 6)
        else:
            put(bytes([min(255, int(m[5]) if m[5] else int(m[3] or m[6] or m[7], 16))]), m.start(), m.end() - m.start())
    put(text[at:].encode("latin-1", "replace"), at, 1)

    def place(k: int) -> int:
        begin, low, step = marks[bisect(marks, k, key=lambda x: x[0]) - 1]
        return low + (k - begin) * step

    def stop(k: int) -> int:
        begin, low, step = marks[bisect(marks, k - 1, key=lambda x: x[0]) - 1]
        return low + (k - begin) * step

    yield from in_bytes(layer, b"".join(parts), place, stop, plain=False)


def utf8(raw: bytes) -> list[tuple[str, int]]:
    """The characters of ``raw`` with their sizes in bytes; bytes that aren't UTF-8 stand for themselves."""
    try:
        text = raw.decode()
        return [(c, len(c.encode())) for c in text]
    except UnicodeDecodeError:
        return [(chr(b), 1) for b in raw]


def utf16(raw: bytes) -> list[tuple[str, int]]:
    text = raw.decode("utf-16-be", "replace")
    return [(c, 4 if ord(c) > 0xFFFF else 2) for c in text]


def readable(raw: bytes) -> str | None:
    """Text, if these bytes are UTF-8 without control characters other than white space."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if re.search(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]", text) else text


def pieces(raw: bytes, bare: bool = False) -> Generator[bytes, None, int]:
    """What a compressed stream holds, all its members or frames, a mebibyte at a time; returns how many bytes of ``raw``
    it takes (0 if it isn't one). Of a broken one, what comes before the fault. ``bare``: raw deflate, of one member."""
    rest, most = raw, 1 << 20
    try:
        while rest:
            if bare or rest[:2] == b"\x1f\x8b" or rest[:1] == b"\x78" and len(rest) > 2 and int.from_bytes(rest[:2]) % 31 == 0:
                tool = zlib.decompressobj(-15 if bare else 47)
                data, fresh = tool.decompress(rest, most), True
                while data or fresh and tool.unconsumed_tail:
                    yield data
                    data = tool.decompress(tool.unconsumed_tail, most) if not tool.eof else b""
                    fresh = False
                if bare:
                    return len(raw) - len(tool.unused_data) if tool.eof else 0
            elif rest[:3] == b"BZh" or rest[:6] == b"\xfd7zXZ\x00":
                tool = bz2.BZ2Decompressor() if rest[:3] == b"BZh" else lzma.LZMADecompressor()
                data = tool.decompress(rest, most)
                while data:
                    yield data
                    data = tool.decompress(b"", most) if not tool.eof and not tool.needs_input else b""
            elif rest[:4] == b"\x28\xb5\x2f\xfd" or rest[1:4] == b"\x2a\x4d\x18" and rest[0] >> 4 == 5:
                tool = zstandard.ZstdDecompressor().decompressobj()
                for k in range(0, len(rest), 256):  # what a few bytes grow to is bounded
                    if data := tool.decompress(rest[k : k + 256]):
                        yield data
                    if tool.eof:
                        rest = tool.unused_data + rest[k + 256 :]
                        break
                else:
                    rest = b""
                continue
            else:
                break
            rest = tool.unused_data.lstrip(b"\0") if tool.eof else b""  # members may be padded
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
        pass
    return len(raw) - len(rest)


def packed(layer: Layer, raw: bytes, region: Region, bare: bool = False) -> Generator[Packed, None, int]:
    """What the stream at the start of ``raw`` holds, in one or, beyond ``LAYER_LIMIT``, in parts that overlap, decompressed
    as it is asked for. Returns how many bytes the stream takes; 0 if it isn't one or holds nothing."""
    found, held, some = pieces(raw, bare), bytearray(), False
    while True:
        try:
            held += next(found)
        except StopIteration as end:
            used = end.value
            break
        if len(held) >= LAYER_LIMIT:
            some = True
            yield Packed(layer, bytes(held), region)
            del held[:-OVERLAP]
    if not some and not held or bare and not used:
        return 0
    if bytes(held) != raw:
        yield Packed(layer, bytes(held), region)
    return used or len(raw)


def opened(item: Packed) -> Iterator[Packed | Layer]:
    """What is in bytes out of a stream: another stream, and what is text in the rest."""
    layer, raw, region = item.layer, item.raw, item.region
    if used := (yield from packed(layer, raw, region)):
        raw = raw[used:]
    text = readable(raw)
    if text is None:  # of other than text, what is text in it
        found = [x.decode() for x in STRETCH.findall(raw)]
        text = "\n".join(found + [wide_text(x) for x in WIDE.findall(raw)])
        done = 0
        for x in STREAM.finditer(raw):
            if x.start() >= done:
                done = x.start() + (yield from packed(layer, raw[x.start() :], region))
    if text:
        yield Layer(text, layer, region=region)


def with_units(layer: Layer, text: str, low: int, high: int, unit: tuple[int, int]) -> Layer:
    """The layer of a text whose bytes are coded in a region, so many characters for so many bytes."""
    offsets = None
    if not text.isascii():
        offsets = [0]
        for c in text:
            offsets.append(offsets[-1] + len(c.encode()))
    return Layer(text, layer, region=Region(low, high), unit=unit, offsets=offsets)


def wide_text(raw: bytes) -> str:
    return raw.replace(b"\0", b"").decode("ascii")


def streams_in(layer: Layer, raw: bytes, place: Callable[[int], int], stop: Callable[[int], int], taken: list) -> Iterator[Packed]:
    """What compressed streams anywhere in ``raw`` hold; ``place`` and ``stop`` tell where the character of a byte begins, and
    where the one before it ends. ``taken`` gets the bytes that streams take."""
    done = 0
    for x in STREAM.finditer(raw):
        if x.start() >= done:
            region = Region(place(x.start()))
            if used := (yield from packed(layer, raw[x.start() :], region)):
                done = x.start() + used
                region.high = stop(done)
                taken.append((x.start(), done))


def in_bytes(layer: Layer, raw: bytes, place: Callable[[int], int], stop: Callable[[int], int], plain: bool = True, taken: list | None = None) -> Iterator[Packed | Layer]:
    """Layers in bytes that aren't text as a whole: compressed streams, and what is text (``plain`` or UTF-16) beside
    them."""
    taken = [] if taken is None else taken
    yield from streams_in(layer, raw, place, stop, taken)
    for x in STRETCH.finditer(raw) if plain else ():
        if not any(low <= x.start() and x.end() <= high for low, high in taken):
            yield Layer(x[0].decode(), layer, [place(k) for k in range(x.start(), x.end())], [stop(k + 1) for k in range(x.start(), x.end())])
    for x in WIDE.finditer(raw):
        if not any(low <= x.start() and x.end() <= high for low, high in taken):
            yield Layer(wide_text(x[0]), layer, [place(k) for k in range(x.start(), x.end(), 2)], [stop(k + 2) for k in range(x.start(), x.end(), 2)])


def block(m: re.Match) -> tuple[str, list[int] | None]:
    """The characters of a coded block without what stands between them, and where each is (None: one after the other)."""
    chars = m[0].rstrip("=")
    if "\n" not in chars and "\\" not in chars:
        return chars, None
    places, at = [], m.start()
    for gap in GAPS.finditer(m.string, m.start(), m.start() + len(chars)):
        places += range(at, gap.start())
        at = gap.end()
    places += range(at, m.start() + len(chars))
    return "".join(m.string[k] for k in places), places


def in_block(layer: Layer, m: re.Match, phases: int, size: int, group: int, decode: Callable[[str], bytes]) -> Iterator[Packed | Layer]:
    """Layers in one coded block, ``group`` characters for ``size`` bytes, whose characters may follow others of its
    alphabet and go on over line ends.

    If the block as a whole isn't text or a compressed stream, it is decoded in all phases, and what is text or a stream
    in the bytes of each is a layer.
    """
    chars, places = block(m)
    for phase in range(phases):
        raw = decode(chars[phase:])

        def place(k: int, phase=phase) -> int:
            """Where the group that holds byte k begins."""
            at = min(len(chars) - 1, phase + k // size * group)
            return places[at] if places else m.start() + at

        def stop(k: int, phase=phase, whole=len(raw)) -> int:
            """Where the group that holds the byte before k ends: with its last character, not after a line end; the block's
            end for the last byte of the whole."""
            if not phase and k >= whole:
                return m.end()
            last = min(len(chars), phase + (k - 1) // size * group + group) - 1
            return places[last] + 1 if places else m.start() + last + 1

        text = readable(raw)
        if not phase and text is not None:
            if places:
                maps = {"lows": [place(k) for k in range(len(raw))], "highs": [stop(k + 1) for k in range(len(raw))]}
                yield Layer(text, layer, **by_character(text, maps))
            else:
                yield with_units(layer, text, m.start(), m.end(), (size, group))
            return
        taken: list[tuple[int, int]] = []
        yield from in_bytes(layer, raw, place, stop, taken=taken)
        if not phase:
            if taken == [(0, len(raw))]:
                return
            if not taken and (yield from packed(layer, raw, Region(m.start(), m.end()), bare=True)) == len(raw):
                return


def base64_bytes(chars: str) -> bytes:
    coded = chars.replace("-", "+").replace("_", "/")
    if len(coded) % 4 == 1:
        coded = coded[:-1]
    return base64.b64decode(coded + "=" * (-len(coded) % 4))


def hex_bytes(chars: str) -> bytes:
    return bytes.fromhex(chars[: len(chars) // 2 * 2])


def by_character(text: str, maps: dict) -> dict:
    """Maps of bytes as maps of the characters that they hold."""
    if text.isascii():
        return maps
    lows, highs, at = [], [], 0
    for c in text:
        lows.append(maps["lows"][at])
        at += len(c.encode())
        highs.append(maps["highs"][at - 1])
    return {"lows": lows, "highs": highs}


def encoded(layer: Layer) -> Iterator[Packed | Layer]:
    """Layers in base64 and hexadecimal regions."""
    for m in BASE64.finditer(layer.text):
        yield from in_block(layer, m, 4, 3, 4, base64_bytes)
    for m in HEX_TEXT.finditer(layer.text):
        if len(m[0]) >= 24:
            yield from in_block(layer, m, 2, 1, 2, hex_bytes)


def unwrapped(layer: Layer) -> Iterator[Packed | Layer]:
    """The layers directly below one."""
    yield from unescaped(layer)
    yield from encoded(layer)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (both sorted by start, then kind, then end) and layers unwrapped."""
    base = sorted(matches(text), key=lambda s: (s[0], s[2], s[1]))
    found, seen, layers = [], set(), 0  # found: layer, start, end, kind
    work = [(text, unwrapped(Layer(text)))]  # a layer's own layers are unwrapped before the next beside it
    while work:
        above, inner = work[-1]
        new = next(inner, None)
        if new is None:
            work.pop()
            continue
        content = new.raw if isinstance(new, Packed) else new.text.encode("utf-8", "surrogatepass")
        if isinstance(new, Layer) and new.text == above or not content:
            continue
        place = (new.layer, new.region) if isinstance(new, Packed) else new.back(0, len(new.text))
        mark = (place, hashlib.blake2b(content, digest_size=16).digest())
        if mark in seen:
            continue
        seen.add(mark)
        if isinstance(new, Packed):
            work.append((None, opened(new)))
            continue
        layers += 1
        for start, end, kind in matches(new.text, inner=True):
            if new.lows is not None and new.highs[end - 1] - new.lows[start] == end - start:
                continue  # no escape in it: the parent's own match, or none by its rules
            found.append((new, start, end, kind))
        work.append((new.text, unwrapped(new)))
    spans = set(base) | {(*layer.back(start, end), kind) for layer, start, end, kind in found}
    return base, sorted(spans, key=lambda s: (s[0], s[2], s[1])), layers


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{low}:{high}" for low, high, k in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with every span (overlapping ones together) replaced by ``mark``."""
    out, at = [], 0
    for low, high, _ in sorted(spans):
        if high <= at:
            continue
        if low >= at:
            out += [text[at:low], mark]
        at = high
    return "".join([*out, text[at:]])


def _in_batches(df: DataFrame, row, schema: str, text: str) -> DataFrame:
    small_batches(df.sparkSession)
    fields = [f.name for f in df.select(text).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(fields[0])
            yield row(b, b.column(at).to_pylist())

    return df.mapInArrow(run, schema)


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base_sha256, spans, n_spans, n_layers.

    Null and empty texts have no spans (the digest of the empty string). Repeated rows stay repeated, null keys stay
    null, an empty table gives no rows; other columns are not read.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, n_layers long"

    def row(b: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        rows = []
        for t in texts:
            base, spans, layers = scan(t or "")
            n = [sum(s[2] == k for s in base) for k in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), layers))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), *cols], [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "n_layers"])

    return _in_batches(docs.select(F.col(key), F.col(text).cast("string").alias(text)), row, schema, text)


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of every text, encoded ones included, replaced by ``[secret]``; nulls stay null.

    Rows and all other columns stay as they are: repeated rows, null keys and empty texts too. An empty table stays empty.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def row(b: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        new = []
        for t in texts:
            spans = scan(t)[1] if t else []
            new.append(redacted(t, spans) if spans else t)
        at = b.schema.get_field_index(text)
        return b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return _in_batches(docs, row, schema, text)

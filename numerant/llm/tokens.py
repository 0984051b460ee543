"""Token ids of whole texts, by the tokenizers library, with a memo of the pieces that cannot influence each other.

Both vocabularies used here cut a text into pieces (a word, a number, a run of punctuation) before anything is merged,
so a piece has the same ids wherever it stands. Plain texts (ASCII and Latin letters, no apostrophes, no double blanks)
are cut with numpy over a whole batch, and the library is asked only for pieces that the memo has not seen. Every other
text goes through the library whole. Both ways give the ids that the library gives for the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from numerant.llm.common import Memo, grouped, run_hashes, span_starts

#: Letters beyond ASCII that the fast way takes: the Latin blocks up to U+024F.
_LETTERS = "\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"  # not the one whose lower case is two characters
#: ``<|`` may open the name of a special token, which the library looks for in the whole text.
_NOT_PLAIN = re.compile(f"[^ -&(-~\n{_LETTERS}]|[ \n][ \n]|<[|]")
_SPACE, _LINE, _LETTER, _DIGIT, _SIGN = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, _SIGN, np.uint8)
    out[128:] = _LETTER
    for low, high in (("a", "z"), ("A", "Z")):
        out[ord(low) : ord(high) + 1] = _LETTER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[ord(" ")], out[ord("\n")] = _SPACE, _LINE
    return out


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(others)}


CLASSES, BYTE_LETTERS = _classes(), _byte_letters()


class Encoder:
    """``ids(texts)`` gives the ids of each text as bytes: unsigned 32-bit little-endian integers."""

    def __init__(self, path: str, memo: int = 150_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None  # then blanks leave no ids and each digit is a piece
        self.memo = Memo(lambda key: None, memo)

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, raw: bytes) -> bytes:
        found = self.model.tokenize(raw.decode("latin-1").translate(BYTE_LETTERS))
        return np.array([t.id for t in found], "<u4").tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        texts = [t or "" for t in texts]
        plain = [k for k, t in enumerate(texts) if t and _NOT_PLAIN.search(t) is None]
        out = [b"" if not t else None for t in texts]
        for part in grouped([len(texts[k]) for k in plain]):
            for at, data in zip(plain[part], self.batch([texts[k] for k in plain[part]]), strict=True):
                out[at] = data
        return [self.direct(t) if data is None else data for t, data in zip(texts, out, strict=True)]

    def batch(self, texts: list[str]) -> list[bytes]:
        """The fast way, for plain texts that are not empty."""
        coded = [(t.lower() if self.lower else t).encode() for t in texts]
        data = b"".join(coded)
        codes = np.frombuffer(data, np.uint8)
        first = span_starts(np.array([len(c) for c in coded], np.int64))
        kind = CLASSES[codes]
        begins = np.empty(len(kind), bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins[first] = True
        if self.lower:
            begins |= kind == _DIGIT
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], len(kind))
            seen = kind[starts] > _LINE
            starts, ends = starts[seen], ends[seen]
        else:
            # A blank opens the piece of what follows it in the same text; alone at a text's end it is a piece.
            glued = np.zeros(len(kind), bool)
            glued[1:] = (kind[:-1] == _SPACE) & (kind[1:] > _LINE)
            glued[first] = False
            begins &= ~glued
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], len(kind))
        hashes = run_hashes(codes, starts, ends)
        keys, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        memo, names = self.memo, keys.tolist()
        found = list(map(memo.get, names))
        for k, value in enumerate(found):
            if value is None:
                value = memo.old.get(names[k])
                if value is None:
                    value = self.piece(data[starts[at[k]] : ends[at[k]]])
                memo.put(names[k], value)
                found[k] = value
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        each = sizes[inverse]
        total = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        ids = flat[np.repeat(span_starts(sizes)[inverse] - total[:-1], each) + np.arange(total[-1])].tobytes()
        cuts = [*(4 * total[np.searchsorted(starts, first)]).tolist(), len(ids)]
        return [ids[low:high] for low, high in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder of each vocabulary per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    return str(public_tokenizers.path(name))

"""URL filter: a bit-parallel wildcard automaton that runs all glob rules at once over each canonical URL.

Every rule is a glob over the canonical URL ``"." + host + path``. Its states are bits; the states of many rules lie side
by side in 64-bit words, so one shift and two masks per character move every rule ahead (Shift-And with self-loops for
wildcards). A batch of URLs moves together, a character position at a time.

Every character that a rule names has a code of its own; all others, which only wildcards take, share one. Rules go in
falling weight into automata of at most ``MOST_WORDS`` words each, and only URLs that no earlier one has judged go on to
the next; URLs move in batches of at most ``STATE_WORDS`` words of states. So memory grows neither with the rules nor
with the URLs of a batch.

Globs: ``**`` is any run of characters, ``*`` any run without ``/``, ``?`` one character other than ``/``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerant.llm.common import ASCII_UPPER, small_batches

MOST_WORDS = 1 << 10  # of an automaton: 65,536 states, some 3,000 rules
STATE_WORDS = 1 << 20  # of a batch of URLs: 8 MB

#: Words that the hosts of junk sites are made of. Every URL without a rule of its own is judged by these.
JUNK_WORDS = (
    "casino", "poker", "slots", "jackpot", "gambl", "betting", "free-bets", "lottery", "pills", "viagra", "cialis", "pharma-deal", "weight-loss", "payday", "quick-loan", "easy-money", "get-rich", "forex-signal",
    "porn", "xxx-", "escort", "adult-", "hookup", "spam", "link-farm", "linkfarm", "click-bait", "clickbait", "replica-watch", "adserv", "ads-track", "essay-mill", "warez", "keygen", "crack-download", "free-followers",
)


@dataclass(frozen=True)
class Rule:
    """``name`` is reported when ``glob`` fits the whole canonical URL; of several, the highest ``weight`` wins."""

    name: str
    action: str
    glob: str
    weight: int


def host_rule(action: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains, and paths that start with ``path``; longer rules win."""
    return Rule(host + path, action, f"*.{host}{path}**", len(host) + len(path))


def junk_globs(words: tuple[str, ...] = JUNK_WORDS) -> list[Rule]:
    """Rules that block hosts with one of these words; the first word wins, and every rule of a host beats them."""
    return [Rule(f"*{w}*/**", "block", f"*{w}*/**", -1 - k) for k, w in enumerate(words)]


def steps_of(glob: str) -> tuple[list[str], list[tuple[int, bool]]]:
    """The characters that a glob takes one after the other (``?``: any but ``/``), and its wildcards: after how many of
    them, and whether ``/`` is among what they take."""
    steps, loops = [], []
    while glob:
        wild = "**" if glob.startswith("**") else glob[0]
        glob = glob[len(wild) :]
        if wild in ("*", "**"):
            loops.append((len(steps), wild == "**"))
        else:
            steps.append(wild)
    return steps, loops


class Automaton:
    """Rules, in falling weight, packed into multiword masks."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        parsed = [steps_of(r.glob) for r in rules]
        starts = np.cumsum([0, *(len(steps) + 1 for steps, _ in parsed)])
        bits = int(starts[-1])
        self.words = max(1, (bits + 63) // 64)
        self.letters = np.array(sorted({ord(c) for steps, _ in parsed for c in steps if c != "?"} | {ord("/")}), np.uint32)
        any_code = np.arange(len(self.letters) + 1)  # the last is that of all other characters
        slash = self.codes_of("/")[0]
        inner = any_code[any_code != slash]
        step, loop = (np.zeros((len(any_code), self.words * 64), bool) for _ in range(2))
        for start, (steps, loops) in zip(starts.tolist(), parsed, strict=False):
            for k, c in enumerate(steps):
                step[inner if c == "?" else self.codes_of(c)[0], start + k + 1] = True
            for k, every in loops:
                loop[any_code if every else inner, start + k] = True
        self.step, self.loop = self.packed(step), self.packed(loop)
        self.ends = starts[1:] - 1
        first, last = (np.zeros((1, self.words * 64), bool) for _ in range(2))
        first[0, starts[:-1]] = True
        last[0, self.ends] = True
        self.first, self.last = self.packed(first)[0], self.packed(last)[0]

    def codes_of(self, text: str) -> np.ndarray:
        found = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, found), len(self.letters) - 1)
        return np.where(self.letters[at] == found, at, len(self.letters)).astype(np.uint32)

    def packed(self, table: np.ndarray) -> np.ndarray:
        return np.packbits(table, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def best(self, urls: list[str]) -> np.ndarray:
        """For each URL the number of the first rule that fits, else -1."""
        size = max(1, STATE_WORDS // self.words)
        return np.concatenate([self._best(urls[k : k + size]) for k in range(0, len(urls), size)] or [np.zeros(0, np.int64)])

    def _best(self, urls: list[str]) -> np.ndarray:
        codes = [self.codes_of(u) for u in urls]
        lengths = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.first, (len(urls), 1))
        longest = int(lengths.max(initial=0))
        # Columns of characters, in pieces so that one very long URL costs no wide matrix.
        for low in range(0, longest, 256):
            live = int((lengths[order] > low).sum())
            block = np.zeros((live, 256), np.uint32)
            for row, k in enumerate(order[:live]):
                part = codes[k][low : low + 256]
                block[row, : len(part)] = part
            for col in range(min(256, longest - low)):
                live = int(np.searchsorted(-lengths[order], -(low + col), "left"))
                now, c = state[:live], block[:live, col]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:live] = (moved & self.step[c]) | (now & self.loop[c])
        reached = state & self.last
        word = (reached != 0).argmax(axis=1)
        held = reached[np.arange(len(urls)), word]
        bit = np.log2((held & (~held + np.uint64(1))).astype(float), where=held > 0, out=np.zeros(len(urls)))  # the lowest
        out = np.empty(len(urls), np.int64)
        out[order] = np.where(held > 0, np.searchsorted(self.ends, word * 64 + bit.astype(np.int64)), -1)
        return out


def automata(rules: list[Rule]) -> list[Automaton]:
    """The rules in falling weight (then by name), in automata of bounded size. A single longer glob has one for itself."""
    out, part, bits = [], [], 0
    for rule in sorted(rules, key=lambda r: (-r.weight, r.name)):
        if part and bits + len(rule.glob) + 1 > 64 * MOST_WORDS:
            out.append(Automaton(part))
            part, bits = [], 0
        part.append(rule)
        bits += len(rule.glob) + 1
    return [*out, Automaton(part)] if part else out


def judged(machines: list[Automaton], urls: list[str]) -> list[Rule | None]:
    """The rule of highest weight that fits each URL."""
    out: list[Rule | None] = [None] * len(urls)
    left = list(range(len(urls)))
    for machine in machines:
        found = machine.best([urls[k] for k in left]).tolist()
        for k, rule in zip(left, found, strict=True):
            if rule >= 0:
                out[k] = machine.rules[rule]
        left = [k for k, rule in zip(left, found, strict=True) if rule < 0]
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lowered) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_UPPER.lower()), path


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule (name of the best rule that fits, else null) and verdict.

    Nulls and texts without ``://`` have an empty host and path and get what the rules say of ``"."``, usually the
    default. Without rules every URL gets the default. Repeated rows stay repeated; an empty table gives no rows; other
    columns of ``pages`` play no part. The rules go to every task, so they should be some megabytes at most.
    """
    small_batches(pages.sparkSession, 10_000)
    shared = pages.sparkSession.sparkContext.broadcast(automata(rules))
    base = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    base = base.select(F.col("_key").alias(key), host.alias("host"), path.alias("path"))
    schema = f"`{key}` {dict(pages.dtypes)[key]}, host string, path string, rule string, verdict string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = judged(shared.value, [f".{h}{p}" for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
            names, verdicts = [r.name if r else None for r in best], [r.action if r else default for r in best]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], [key, "host", "path", "rule", "verdict"])

    return base.mapInArrow(judge, schema)

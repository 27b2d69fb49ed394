"""Counting byte-level BPE tokens without encoding most of the text.

Whole-token shortcut: before a run, every vocabulary string that is a pre-token is
merged once, and those that end as one token are kept as a set.  A pre-token of a text
that is in the set counts one; only the others go through the merges, and a task
remembers the counts of a bounded number of them.

Defined cases: null and empty texts have 0 tokens; special strings inside a text count as
the library's default has it (one token each, the text is cut there); repeated rows are
counted like any other; other columns are kept unless they have the name of a result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from inkfold.llm.mapping import map_texts

#: Counts that a task remembers before it starts anew.
STORED_COUNTS = 800_000

# The split of byte-level pre-tokens, with any script's letters and numbers ...
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ... and the same classes among the first 256 code points, for a faster engine.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_ANY = regex.compile(PATTERN)


def pre_tokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ANY.findall(text)
    return _LATIN.findall(text)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand
    for themselves, the rest follow in order from code point 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merges of a vocabulary file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            content = json.load(f)
        model, letters = content["model"], _byte_letters()
        kind = content.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or content.get("normalizer"):
            raise ValueError("only byte-level BPE without a normaliser and prefix blank is counted")
        vocabulary = model["vocab"]
        self.byte_ids = [0] * 256
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocabulary[letter]
        self.pairs: dict[int, int] = {}  # rank and merged id, by the two ids
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocabulary[a] << 24 | vocabulary[b]] = rank << 24 | vocabulary[a + b]
        self.strings = [bytes(letters[c] for c in s) for s in vocabulary if all(c in letters for c in s)]
        self.special = sorted((t["content"] for t in content.get("added_tokens") or []), key=len, reverse=True)

    def count(self, data: bytes) -> int:
        """Tokens that the bytes of one pre-token become."""
        if len(data) > 200:
            return self._count_long(data)
        get, byte_ids, none = self.pairs.get, self.byte_ids, 1 << 60
        ids = [byte_ids[b] for b in data]
        found = [get(a << 24 | b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            del found[i], ids[i]
            ids[i] = made = best & 0xFFFFFF
            if i:
                found[i - 1] = get(ids[i - 1] << 24 | made, none)
            if i < len(found):
                found[i] = get(made << 24 | ids[i + 1], none)
        return len(ids)

    def _count_long(self, data: bytes) -> int:
        """The same with a heap, for pre-tokens of any length."""
        ids = [self.byte_ids[b] for b in data]
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.pairs.get(ids[i] << 24 | ids[j])):
                heapq.heappush(heap, (found >> 24, i, ids[i], ids[j], found & 0xFFFFFF))

        for i in range(len(ids) - 1):
            offer(i)
        left = len(ids)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            left -= 1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return left

    def whole_tokens(self) -> list[str]:
        """Vocabulary strings that, as a pre-token, encode alone as one token."""
        out = []
        for raw in self.strings:
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if pre_tokens(text) == [text] and self.count(raw) == 1:
                out.append(text)
        return out


@lru_cache(maxsize=4)
def _merges(file: str) -> Merges:
    return Merges(file)


@lru_cache(maxsize=4)
def whole_tokens(file: str) -> tuple[str, ...]:
    """The proof, made once by the driver; its size is bounded by the vocabulary."""
    return tuple(_merges(file).whole_tokens())


class _Costs(dict):
    """Tokens of a pre-token: one for proven strings, else by merging."""

    def __init__(self, whole: Iterable[str], merges: Merges):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merges = whole, merges

    def __missing__(self, token: str) -> int:
        n = self.merges.count(token.encode())
        if len(self) > STORED_COUNTS + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        if len(token) <= 64:
            self[token] = n
        return n


_COSTS: dict[str, _Costs] = {}

COUNTED = "n_bytes long, n_tokens long"


def count_tokens(df: DataFrame, file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default all), n_bytes (UTF-8) and n_tokens."""
    whole = df.sparkSession.sparkContext.broadcast(whole_tokens(file))

    def make():
        if file not in _COSTS:
            _COSTS[file] = _Costs(whole.value, _merges(file))
        cost = _COSTS[file].__getitem__
        special = _merges(file).special
        cut = re.compile("|".join(map(re.escape, special))) if special else None

        def count(data: bytes) -> int:
            decoded = data.decode("utf-8", "replace")
            pieces = cut.split(decoded) if cut else [decoded]
            return len(pieces) - 1 + sum(sum(map(cost, pre_tokens(p))) for p in pieces)

        return lambda texts: {"n_bytes": [len(t) for t in texts], "n_tokens": [count(t) for t in texts]}

    return map_texts(df, make, COUNTED, text, keep)

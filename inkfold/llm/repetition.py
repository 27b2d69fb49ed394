"""Quality rules on repetition, from a suffix array over the words of each text.

Suffixes are sorted by doubling: once their first k words are ranked, the ranks of a
suffix and of the one k words on rank the first 2k.  Only suffixes that still share their
rank are sorted again.  The ranks of every step also give the longest common prefix of
neighbours.  A suffix's longest repeat is the larger of its two, so the union of these
spans is the union of the maximal repeated substrings (the longest-common-prefix
intervals) of `min_words` words or more.  A text is kept if the share of its words that
they cover and the longest of them stay within limits.

Beside that, plain counts: words, their characters, symbols, repeated lines, words in
repeated windows.  A word is `[^\\x20\\x09-\\x0D]+`; texts are compared as they are.

Defined cases: null and empty texts have no words and fail the base rule; repeated rows are
judged alike and each alone; an empty table gives an empty table; other columns stay
unless they have the name of a result.  Memory is that of one chunk of texts, and for a
text larger than a chunk, of this text times the number of doublings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from inkfold.llm.mapping import map_texts
from inkfold.llm.words import Words, code_points, range_hashes, split_words, window_hashes

#: Characters counted as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10  # of a repeat that counts
    max_covered: float = 0.3  # share of words inside repeats
    max_longest: int = 100  # words
    window: int = 3
    least_words: int = 50
    most_repeated_percent: int = 50


def longest_repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each word, the length of the longest string that starts there and stands
    elsewhere in the same text too.  `first`: of each text's words, one more at the end."""
    n = len(hashes)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    stop = np.repeat(first[1:], counts)
    order = np.lexsort((hashes, text))
    new = np.ones(n, bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is the place of its first
    rank = np.empty(n, np.int32)
    rank[order] = begin
    levels = [rank.copy()]
    shared = np.zeros(n, bool)
    shared[1:] = ~new[1:]
    shared[:-1] |= ~new[1:]
    active = order[shared]
    k = 1
    while len(active):
        ahead = active + k
        second = np.where(ahead < stop[active], rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        group = rank[active].astype(np.int64)
        by = np.argsort(group * (n + 1) + second, kind="stable")
        active, group, second = active[by], group[by], second[by]
        head = np.ones(len(active), bool)
        head[1:] = group[1:] != group[:-1]
        new = head.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(active))
        base = at[head][np.cumsum(head) - 1]
        sub = at[new][np.cumsum(new) - 1]
        rank[active] = group + (sub - base)
        shared = np.zeros(len(active), bool)
        shared[1:] = ~new[1:]
        shared[:-1] |= ~new[1:]
        k *= 2
        if shared.any():
            levels.append(rank.copy())
        active = active[shared]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    pair = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    left, right = suffixes[pair], suffixes[pair + 1]
    common = np.zeros(len(pair), np.int64)
    p, q = left.copy(), right.copy()
    for level in range(len(levels) - 1, -1, -1):
        inside = (p < n) & (q < n)
        same = np.zeros(len(pair), bool)
        same[inside] = levels[level][p[inside]] == levels[level][q[inside]]
        step = same * (1 << level)
        common, p, q = common + step, p + step, q + step
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=upto[1:])
    return upto[first[1:]] - upto[first[:-1]]


def repeated(words: Words, hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: words inside repeats of `least` words or more, and the longest repeat."""
    longest = longest_repeats(hashes, words.first)
    change = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    covered = _sums(np.cumsum(change[:-1]) > 0, words.first)
    top = np.zeros(len(words.counts), np.int64)
    np.maximum.at(top, words.text, longest)
    return covered, top


def _repeated_windows(words: Words, hashes: np.ndarray, size: int) -> np.ndarray:
    """Of each text: words in windows that stand in it twice or more."""
    window, at = window_hashes(hashes, words.text, size)
    order = np.lexsort((window, words.text[at]))
    w, t = window[order], words.text[at][order]
    again = (w[1:] == w[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(w), bool)
    twice[1:] |= again
    twice[:-1] |= again
    marked = np.zeros(len(hashes), bool)
    for k in range(size):
        marked[at[order[twice]] + k] = True
    return _sums(marked, words.first)


def _repeated_lines(words: Words) -> np.ndarray:
    """Of each text: lines with a word that equal an earlier line of the text."""
    end = np.flatnonzero(words.buffer == 0x0A)
    start = np.concatenate((np.zeros(min(1, len(end)), np.int64), end[:-1] + 1))
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[full], end[full]
    text = np.searchsorted(words.text_start, start, side="right") - 1
    line = range_hashes(words.buffer, start, end)
    order = np.lexsort((line, text))
    again = (line[order[1:]] == line[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    # Equal hashes only say where to look: lines are counted when their bytes are equal.
    out, seen = np.zeros(len(words.counts), np.int64), set()
    data = words.buffer.tobytes()
    for k in np.flatnonzero(again):
        i, j = order[k], order[k + 1]
        if not k or not again[k - 1]:
            seen = {data[start[i] : end[i]]}
        own = data[start[j] : end[j]]
        out[text[j]] += own in seen
        seen.add(own)
    return out


MEASURED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def measure(texts: list[bytes], rules: Rules) -> dict[str, np.ndarray]:
    words = split_words(texts)
    hashes = range_hashes(words.buffer, words.start, words.end)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    points = code_points(words.buffer)
    n_words = words.counts
    covered, top = repeated(words, hashes, rules.min_words)
    in_windows = _repeated_windows(words, hashes, rules.window)
    failed = (n_words < rules.least_words) | (100 * in_windows > rules.most_repeated_percent * n_words)
    good = (covered <= rules.max_covered * n_words) & (top <= rules.max_longest)
    return {
        "n_words": n_words,
        "word_chars": _sums(points[words.end] - points[words.start], words.first),
        "n_symbols": _sums(symbol[words.buffer], words.text_start),
        "n_dup_lines": _repeated_lines(words),
        "n_repeat_words": in_windows,
        "covered_words": covered,
        "longest_repeat": top,
        "base_failed": failed,
        "kept": ~failed & good,
    }


def quality(df: DataFrame, rules: Rules = Rules(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default all) and the measures and verdict of each text."""
    return map_texts(df, lambda: lambda texts: measure(texts, rules), MEASURED, text, keep)

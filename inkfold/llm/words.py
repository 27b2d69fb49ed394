"""Words of many texts as arrays: places, hashes, windows.

A word is `[^\\x20\\x09-\\x0D]+`.  The texts of a chunk stand in one byte array, one
line end between them, so a word never reaches from one text into the next.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Ranges above this many bytes are hashed one by one.
LONG = 1 << 12


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """The words of a chunk in order."""

    buffer: np.ndarray  # bytes of all texts
    text_start: np.ndarray  # of each text, one more at the end
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # number of the text
    first: np.ndarray  # of each text's words, one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(texts: list[bytes], lower: bool = False) -> Words:
    joined = b"\n".join(texts) + b"\n"
    buffer = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    text_start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=text_start[1:])
    space = _SPACE[buffer]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    first = np.searchsorted(start, text_start)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buffer, text_start, start, end, text, first)


def range_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range.

    Eight bytes are mixed at a time into what the bytes before have left, for all ranges
    together; no sum of powers, so texts of regular structure do not collide.
    """
    start, size = np.asarray(start, np.int64), np.asarray(end - start, np.int64)
    out = mix(size.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    blocks = np.ndarray(len(buffer) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    todo, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(todo):
        left = size[todo] - at
        block = blocks[start[todo] + at]
        unused = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
        block = block << unused >> unused
        out[todo] = mix((out[todo] ^ block) * np.uint64(0x9E3779B97F4A7C15))
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(size > LONG):
        data = buffer[start[i] : start[i] + size[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")
    return out


def window_hashes(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each window of `size` words inside one text, and its first word's number."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0x9FB21C651E98DF25) + hashes[at + k] + np.uint64(k + 1))
    return total, at


def code_points(buffer: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte, one more at the end."""
    out = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum((buffer & 0xC0) != 0x80, out=out[1:])
    return out

"""SentencePiece encoding that keeps the place of every piece in the source, and decoding.

A text is normalised first: at each place the longest prefix that stands in the model's
compiled character map (a double-array trie) is replaced, and for every byte that
results the place it came from is recorded.  The library then cuts the normalised text
into pieces with a copy of the model that normalises nothing, and each piece's bytes are
projected through the record to a byte span of the source.

Merges cannot reach over the front of a word or over a line end if no piece does; that is
proved from the vocabulary once.  Where it holds, a text is cut there and each distinct
part is encoded once per task (a bounded store of answers); else a text is one part.

Defined cases: null is an empty text; an empty text has no ids and decodes to an empty
text; a byte that is no valid UTF-8 becomes U+FFFD, as in the library; repeated rows are
encoded like any other; other columns are kept unless they have the name of a result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from inkfold.llm.mapping import map_texts

SPACE = "▁"
#: Distinct parts whose ids a task remembers before it starts anew; those of one chunk
#: of texts come on top.
STORED_PARTS = 300_000

ENCODED = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "decoded": "string"}


class CharacterMap:
    """The compiled map of a model: a double-array trie and the texts it points to."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix at a place that the map knows, and its replacement."""
        units = self.units
        if not units:
            return None
        found, node = None, self._children(0, units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node = self._children(node, unit)
            if unit >> 8 & 1:
                found = i - at + 1, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]

    @staticmethod
    def _children(node: int, unit: int) -> int:
        return node ^ (unit >> 10) << ((unit & 1 << 9) >> 6)


def _character(data: bytes, at: int) -> tuple[int, bytes]:
    """The UTF-8 character at a place and its length; an invalid byte is U+FFFD."""
    first = data[at]
    size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    raw = data[at : at + size]
    try:
        raw.decode()
        return size, raw
    except UnicodeDecodeError:
        return 1, "�".encode()


class Normalizer:
    """The model's normalisation with, for each byte made, the source byte it stands for."""

    def __init__(self, spec, user_symbols: list[str]):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy = spec.add_dummy_prefix
        self.trim = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.suffix = False
        self.symbols = sorted((s.encode() for s in user_symbols), key=len, reverse=True)
        self.plain = not self.map.units and not self.trim and not self.symbols

    def _next(self, data: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.symbols:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        return self.map.longest(data, at) or _character(data, at)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and a source place for each of them and for their end."""
        if self.plain and not self.suffix:
            return self._plain(data)
        space = SPACE.encode() if self.escape else b" "
        out, origin, at = bytearray(), [], 0

        def put(raw: bytes, place: int) -> None:
            out.extend(raw)
            origin.extend([place] * len(raw))

        if self.trim:
            while at < len(data) and self._next(data, at)[1] == b" ":
                at += self._next(data, at)[0]
        if at == len(data):
            return b"", np.array([len(data)], np.int32)
        if self.dummy and not self.suffix:
            put(space, at)
        after_space = self.trim
        while at < len(data):
            size, made = self._next(data, at)
            while after_space and made.startswith(b" "):
                made = made[1:]
            for byte in made:
                put(space if byte == 0x20 else bytes([byte]), at)
            if made:
                after_space = self.trim and made.endswith(b" ")
            at += size
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :]
                at = origin[len(out)]
                del origin[len(out) :]
        if self.dummy and self.suffix:
            put(space, at)
        return bytes(out), np.array([*origin, at], np.int32)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The same without a map and without trimming: only blanks grow."""
        if not data:
            return b"", np.zeros(1, np.int32)
        space = SPACE.encode() if self.escape else b" "
        try:
            data.decode()
        except UnicodeDecodeError:
            self_slow = Normalizer.__new__(Normalizer)
            self_slow.__dict__ = self.__dict__ | {"plain": False}
            return self_slow(data)
        width = np.ones(len(data), np.int32)
        width[np.frombuffer(data, np.uint8) == 0x20] = len(space)
        origin = np.repeat(np.arange(len(data), dtype=np.int32), width)
        front = space if self.dummy else b""
        places = np.concatenate((np.zeros(len(front), np.int32), origin, np.array([len(data)], np.int32)))
        return front + data.replace(b" ", space), places


class Codec:
    """Encoding and decoding with one model file."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(model_file, "rb") as f:
            raw = f.read()
        model = proto.ModelProto()
        model.ParseFromString(raw)
        kinds = {t: k for k, t in proto.ModelProto.SentencePiece.Type.items()}
        pieces = [(p.piece, kinds[p.type]) for p in model.pieces]
        self.normalize = Normalizer(model.normalizer_spec, [p for p, k in pieces if k == "USER_DEFINED"])
        self.normalize.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.bytes_of = np.array([1 if k == "BYTE" else len(p.encode()) for p, k in pieces], np.int64)
        self.unknown = next((i for i, (_, k) in enumerate(pieces) if k == "UNKNOWN"), -1)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        # The segmenter takes what the normaliser above has made and changes nothing more.
        spec = model.normalizer_spec
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.parts = self._cutter([p for p, k in pieces if k in ("NORMAL", "USER_DEFINED")], model.trainer_spec)
        self.digits = [str(i).encode() for i in range(len(pieces))]
        self._forget()

    def _forget(self) -> None:
        self.store: dict[str, int] = {}
        self.first, self.count, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _cutter(pieces: list[str], trainer) -> Callable[[str], list[str]] | None:
        """A cut into parts that no piece reaches over; None where that can't be proved.

        Characters are of three kinds: the blank, marks (ASCII that is no letter, and
        what pieces join to it), and the rest.  Parts are runs of one kind with the
        blanks before them; every piece is checked to be of one kind but for blanks in front.
        """
        if trainer.model_type != 2 or not trainer.byte_fallback:
            return None
        bodies = [p.lstrip(SPACE) for p in pieces]
        if any(SPACE in b for b in bodies):
            return None
        marks = {chr(i) for i in range(128) if not chr(i).isalpha()}
        grown = True
        while grown:
            mixed = [b for b in bodies if 0 < sum(c in marks for c in b) < len(b)]
            grown = bool(mixed)
            marks.update(chain.from_iterable(mixed))
            if any(c.isascii() and c.isalpha() for c in marks):
                return None
        kind = "".join(map(re.escape, sorted(marks)))
        return re.compile(f"{SPACE}*[^{SPACE}{kind}]+|{SPACE}*[{kind}]+|{SPACE}+").findall

    def _learn(self, new: list[str]) -> None:
        made = self.segmenter.encode(new, num_threads=1)
        self.store.update(zip(new, range(len(self.store), len(self.store) + len(new)), strict=True))
        count = np.fromiter(map(len, made), np.int64, len(new))
        total = self.first[-1] + count.sum()
        if total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(int(total), 1 << 16), np.int32)))
        self.flat[self.first[-1] : total] = np.fromiter(chain.from_iterable(made), np.int32)
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(count)))
        self.count = np.concatenate((self.count, count))

    def segment(self, normalized: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts."""
        if self.parts is None:
            return [np.array(i, np.int32) for i in self.segmenter.encode(normalized, num_threads=1)]
        parts = list(map(self.parts, normalized))
        which = np.fromiter(map(self.store.get, chain.from_iterable(parts), repeat(-1)), np.int64)
        if (which < 0).any():
            if len(self.store) > STORED_PARTS:
                self._forget()
            self._learn([p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in self.store])
            which = np.fromiter(map(self.store.__getitem__, chain.from_iterable(parts)), np.int64)
        count = self.count[which]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
        ids = self.flat[np.repeat(self.first[which] - upto[:-1], count) + np.arange(upto[-1])]
        cut = upto[np.cumsum(list(map(len, parts)))]
        return np.split(ids, cut[:-1])

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text its ids, and of each id the first byte and the byte after the last
        in the source."""
        out = []
        made, places = zip(*map(self.normalize, texts), strict=True)
        normalized = [m.decode() for m in made]
        for i, ids in enumerate(self.segment(normalized)):
            sizes = self.bytes_of[ids]
            if self.unknown >= 0 and (ids == self.unknown).any():
                pieces = self.segmenter.encode(normalized[i], out_type=str)
                sizes = np.array([1 if self.library.is_byte(int(i)) else len(p.encode()) for i, p in zip(ids, pieces, strict=True)], np.int64)
            ends = np.cumsum(sizes)
            if (ends[-1] if len(ids) else 0) != len(made[i]):
                raise ValueError("the pieces do not cover the normalised text")
            out.append((ids, places[i][ends - sizes], places[i][ends]))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [d if len(i) else "" for d, i in zip(self.library.decode([i.tolist() for i in ids], num_threads=1), ids, strict=True)] if ids else []

    def digest(self, ids: np.ndarray) -> str:
        """Of the decimal ids joined by commas."""
        return hashlib.sha256(b",".join([self.digits[i] for i in ids.tolist()])).hexdigest()


def _lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))


def encode(
    df: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None, columns: tuple[str, ...] = tuple(ENCODED)
) -> DataFrame:
    """Columns `keep` (default all) and of these the named ones: ids, starts and ends of the
    pieces (bytes of the source, end exclusive), and the text that the ids decode to."""

    def make():
        codec = Codec(model_file)

        def call(texts: list[bytes]) -> dict:
            ids, starts, ends = zip(*codec.encode(texts), strict=True)
            lists = {"ids": ids, "starts": starts, "ends": ends}
            return {c: codec.decode(list(ids)) if c == "decoded" else _lists(lists[c]) for c in columns}

        return call

    return map_texts(df, make, ", ".join(f"{c} {ENCODED[c]}" for c in columns), text, keep)


def decode(df: DataFrame, model_file: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Column `decoded`: the text of a column of ids (null and empty: an empty text)."""
    @F.pandas_udf("string")
    def text_of(columns: pd.Series) -> pd.Series:
        codec = _codec(model_file)
        return pd.Series(codec.decode([np.asarray([] if v is None else v, np.int32) for v in columns]))

    kept = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    return df.select(*kept, text_of(F.col(ids)).alias("decoded"))


_CODECS: dict[str, Codec] = {}


def _codec(model_file: str) -> Codec:
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def _cover(starts: np.ndarray, ends: np.ndarray, size: int) -> bool:
    """In order, and from the first byte to the last."""
    if not len(starts):
        return True
    return bool(starts[0] == 0 and ends[-1] == size and (starts[1:] >= starts[:-1]).all() and (ends >= starts).all())


SUMMARY = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_cover boolean"


def encode_summary(df: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """What `encode` gives, told in four columns that are cheap to move: the number of
    ids, digests of ids and decoded text, and whether the spans are in order and reach
    from the text's first byte to its last."""

    def make():
        codec = Codec(model_file)

        def call(texts: list[bytes]) -> dict:
            encoded = codec.encode(texts)
            decoded = codec.decode([e[0] for e in encoded])
            return {
                "n_tokens": [len(ids) for ids, _, _ in encoded],
                "ids_sha256": [codec.digest(ids) for ids, _, _ in encoded],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                "spans_cover": [_cover(s, e, len(t)) for (_, s, e), t in zip(encoded, texts, strict=True)],
            }

        return call

    return map_texts(df, make, SUMMARY, text, keep)

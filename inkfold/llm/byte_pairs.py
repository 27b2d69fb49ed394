"""Byte-level BPE by a table of distinct words.

1. Spark tasks split texts into words (the pre-tokens of the vocabulary file, and special
   strings).  A chunk of texts keeps its distinct words once, and of each text the numbers of
   its words in that list, in order.
2. The chunks' words are dealt by word, and each distinct word of the whole table is merged
   once.  Its ids are decoded by a join with the pieces of the vocabulary.
3. The encoded words go back to the chunks by (chunk, number), and a text's ids are those of
   its words by position.

Texts are not shuffled, and a word is shuffled once a chunk, not once an occurrence.  Words
and numbers lie in bucketed tables in the shared folder, so that the joins on them move one
side at most; a word that every chunk has is one row a chunk, in a sorted stream.

Defined cases: null and empty texts have no ids and decode to an empty text; special strings
inside a text are cut out and become their own id, as is the library's default; bytes that are
no UTF-8 count as U+FFFD; repeated rows are encoded like any other; a null id is kept; kept
columns with the name of a result give way to it; an empty table gives an empty table.
Ids that the vocabulary does not have decode to nothing, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from inkfold.llm.landing import Landing
from inkfold.llm.token_counts import Merges, _byte_letters, pre_tokens

#: Bytes of text that share a list of words (one longer text has its own).
CHUNK_BYTES = 32 << 20
#: Pre-tokens above this many bytes are merged with a heap.
LONG = 100

_CHUNK, _NUMBERS, _WORDS = "__chunk", "__numbers", "__words"


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first: the planes of small numbers' high bytes pack to nothing."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


class Vocabulary:
    """The merges, special strings and pieces of a vocabulary file."""

    def __init__(self, file: str):
        self.merges = Merges(file)
        with open(file, encoding="utf-8") as f:
            content = json.load(f)
        added = content.get("added_tokens") or []
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special strings that take blanks or word borders into account are not encoded")
        self.special = {t["content"]: t["id"] for t in added}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        letters = _byte_letters()
        self.pieces = {i: bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode() for s, i in content["model"]["vocab"].items()}
        self.pieces |= {i: s.encode() for s, i in self.special.items()}

    def words(self, text: str) -> list[str]:
        if not self.cut:
            return pre_tokens(text)
        parts = self.cut.split(text)
        if len(parts) == 1:
            return pre_tokens(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else pre_tokens(part))]

    def encode(self, word: str) -> list[int]:
        """The ids of one word."""
        if word in self.special:
            return [self.special[word]]
        data = word.encode()
        ids = [self.merges.byte_ids[b] for b in data]
        return self._merged(ids) if len(ids) <= LONG else self._merged_by_heap(ids)

    def _merged(self, ids: list[int]) -> list[int]:
        """The pair of lowest rank is merged wherever it stands, until no pair has a rank."""
        rank = self.merges.pairs.get
        while len(ids) > 1:
            found, a, b = min((rank(a << 24 | b, 1 << 60), a, b) for a, b in zip(ids, ids[1:]))
            if found == 1 << 60:
                break
            out, i = [], 0
            while i < len(ids):
                if ids[i] == a and i + 1 < len(ids) and ids[i + 1] == b:
                    out.append(found & 0xFFFFFF)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same for words of any length: pairs wait in a heap, neighbours are linked."""
        rank, end = self.merges.pairs.get, len(ids)
        following, previous = list(range(1, end + 1)), list(range(-1, end - 1))
        waiting = [(found, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (found := rank(a << 24 | b)) is not None]
        # The rank stands above the merged id: lowest rank first, then the leftmost.
        waiting = [(found >> 24, i, a, b, found & 0xFFFFFF) for found, i, a, b in waiting]
        heapq.heapify(waiting)
        while waiting:
            _, i, a, b, made = heapq.heappop(waiting)
            j = following[i] if ids[i] == a else end
            if j >= end or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            following[i] = k = following[j]
            if k < end:
                previous[k] = i
            for left, right in ((previous[i], i), (i, k)):
                if left >= 0 and right < end and (found := rank(ids[left] << 24 | ids[right])) is not None:
                    heapq.heappush(waiting, (found >> 24, left, ids[left], ids[right], found & 0xFFFFFF))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=4)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


class _Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _split(df: DataFrame, file: str, text: str, kept: list[str], chunk_bytes: int) -> DataFrame:
    """The kept columns, the chunk, and the numbers of the text's words; a chunk's first row
    holds its words, the commonest first."""
    ready = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias(_NUMBERS))
    out = StructType([ready.schema[c] for c in kept]).add(_CHUNK, "long").add(_NUMBERS, "binary").add(_WORDS, ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target, of = to_arrow_schema(out), vocabulary(file)
        chunk = TaskContext.get().partitionId() << 33
        held: list[tuple[list, list[np.ndarray]]] = []
        numbers, size = _Numbers(), 0

        def done() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate([n for _, rows in held for n in rows])
            order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            names = list(numbers)
            words = [[names[i] for i in order]]
            for columns, rows in held:
                made = [pa.array([chunk] * len(rows), pa.int64()), pa.array([planes(rank[n]) for n in rows], pa.binary())]
                words += [None] * (len(rows) - len(words))
                made.append(pa.array(words, target.field(_WORDS).type))
                words = []
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, *made], target, strict=True)], schema=target)

        for batch in batches:
            first, rows = 0, []
            texts = batch.column(len(kept))
            for i in range(batch.num_rows):
                data = texts[i].as_py() or b""
                if size and size + len(data) > chunk_bytes:
                    held.append(([batch.column(k).slice(first, i - first) for k in range(len(kept))], rows))
                    yield from done()
                    first, rows, held, numbers, size, chunk = i, [], [], _Numbers(), 0, chunk + 1
                words = of.words(data.decode("utf-8", "replace"))
                rows.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(data)
            if rows:
                held.append(([batch.column(k).slice(first) for k in range(len(kept))], rows))
        if any(rows for _, rows in held):
            yield from done()

    return ready.mapInArrow(run, out)


def _encoded(words: DataFrame, file: str) -> DataFrame:
    """Each distinct word and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(file)
        for batch in batches:
            ids = [of.encode(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def piece_table(spark, file: str) -> DataFrame:
    """Rows (id, piece): bounded by the vocabulary, so it may be broadcast."""
    found = vocabulary(file).pieces
    rows = pa.table({"id": pa.array(list(found), pa.int32()), "piece": pa.array(list(found.values()), pa.binary())})
    return F.broadcast(spark.createDataFrame(rows))


def _joined(pieces):
    """Pieces in the order of their places."""
    return F.aggregate(F.array_sort(pieces), F.lit(b""), lambda text, p: F.concat(text, p["piece"]))


def _decoded(encoded: DataFrame, file: str) -> DataFrame:
    """Of each word its ids, and its bytes by a join of ids with pieces."""
    one = encoded.select("word", F.posexplode("ids").alias("at", "id")).join(piece_table(encoded.sparkSession, file), "id")
    return one.groupBy("word").agg(F.collect_list(F.struct("at", "id", "piece")).alias("found")).select(
        "word", F.transform(F.array_sort("found"), lambda p: p["id"]).alias("ids"), _joined("found").alias("decoded"))


BLOB = "chunk long, n int, at binary, n_ids binary, ids binary, n_bytes binary, decoded binary"


def _by_chunk(rows: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """Rows (chunk, at, ids, decoded) packed into a row for each chunk, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("chunk").combine_chunks()
            chunk = table.column("chunk").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            out: dict[str, list] = {name: [] for name in ("chunk", "n", "at", "n_ids", "ids", "n_bytes", "decoded")}
            for a, b in zip(first, [*first[1:], len(chunk)], strict=True):
                part = table.slice(a, b - a)
                ids, decoded = (part.column(c).combine_chunks() for c in ("ids", "decoded"))
                out["chunk"].append(int(chunk[a]))
                out["n"].append(b - a)
                out["at"].append(planes(part.column("at").to_numpy()))
                out["n_ids"].append(planes(ids.value_lengths().to_numpy()))
                out["ids"].append(planes(ids.flatten().to_numpy()))
                texts = decoded.to_pylist()
                out["n_bytes"].append(planes(np.array([len(t) for t in texts], np.int32)))
                out["decoded"].append(b"".join(texts))
            return pa.RecordBatch.from_arrays([
                pa.array(v, pa.int64() if k == "chunk" else pa.int32() if k == "n" else pa.binary()) for k, v in out.items()], list(out))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= limit:
                yield packed()
                held = []
        if held:
            yield packed()

    return rows.select("chunk", "at", "ids", "decoded").mapInArrow(run, BLOB)


class _Entries:
    """The encoded words of a chunk by their numbers."""

    def __init__(self, blobs: pa.Table):
        self.ids: list = [None] * sum(blobs.column("n").to_pylist())
        self.decoded: list[bytes] = [b""] * len(self.ids)
        for blob in blobs.to_pylist():
            at = from_planes(blob["at"]).tolist()
            ids = np.split(from_planes(blob["ids"]), np.cumsum(from_planes(blob["n_ids"]))[:-1])
            upto = np.cumsum(from_planes(blob["n_bytes"])).tolist()
            for i, own, start, end in zip(at, ids, [0, *upto], upto):
                self.ids[i], self.decoded[i] = own, blob["decoded"][start:end]

    def digits(self) -> list[bytes]:
        """Of each word its decimal ids, joined by commas."""
        return [b",".join([b"%d" % i for i in ids.tolist()]) for ids in self.ids]


RESULTS = {
    "n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string",
}


def _assembled(rows: DataFrame, blobs: DataFrame, kept: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Kept columns and results of each text, a chunk at a time."""
    made_of = StructType.fromDDL(", ".join(f"{c} {RESULTS[c]}" for c in columns))
    out = StructType([rows.schema[c] for c in kept] + made_of.fields)

    def run(texts: pa.Table, packed: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, entries = to_arrow_schema(out), _Entries(packed)
        numbers = [from_planes(n) for n in texts.column(_NUMBERS).to_pylist()]
        made: dict[str, list] = {}
        if "n_tokens" in columns:
            length = np.array([len(i) for i in entries.ids], np.int64)
            made["n_tokens"] = [int(length[n].sum()) for n in numbers]
        if "ids" in columns:
            made["ids"] = [np.concatenate([entries.ids[i] for i in n]) if len(n) else np.empty(0, np.int32) for n in numbers]
        if "ids_sha256" in columns:
            digits = entries.digits().__getitem__
            made["ids_sha256"] = [hashlib.sha256(b",".join(map(digits, n.tolist()))).hexdigest() for n in numbers]
        if "decoded" in columns or "decoded_sha256" in columns:
            piece = entries.decoded.__getitem__
            texts_again = (b"".join(map(piece, n.tolist())).decode("utf-8", "replace") for n in numbers)
            if "decoded" in columns:
                made["decoded"] = list(texts_again)
                texts_again = made["decoded"]
            if "decoded_sha256" in columns:
                made["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in texts_again]
        own = [texts.column(c).cast(target.field(c).type) for c in kept]
        return pa.Table.from_arrays([*own, *[pa.array(made[c], target.field(c).type) for c in columns]], schema=target)

    return rows.groupBy(F.col(_CHUNK)).cogroup(blobs.groupBy(F.col("chunk"))).applyInArrow(run, out)


def encode(
    df: DataFrame, file: str, text: str = "text", keep: list[str] | None = None,
    columns: tuple[str, ...] = ("ids", "decoded"), chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Columns `keep` (default all) and of these the named ones: n_tokens, ids, the text that
    they decode to, and digests of the decimal ids joined by commas and of the decoded text."""
    spark = df.sparkSession
    landing = Landing(spark, "byte-pairs")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = {c.lower() for c in columns} | {_CHUNK, _NUMBERS, _WORDS}
    kept = list(dict.fromkeys(c for c in (df.columns if keep is None else keep) if c.lower() not in taken))
    split = landing.land_bucketed(_split(df, file, text, kept, chunk_bytes), buckets, _CHUNK)
    listed = split.filter(F.col(_WORDS).isNotNull()).select(F.col(_CHUNK).alias("chunk"), F.posexplode(_WORDS).alias("at", "word"))
    places = landing.land_bucketed(listed.repartition(buckets, "word").sortWithinPartitions("word"), buckets, "word")
    # From here on a word stays in its bucket: no shuffle until the words go back to their chunks.
    words = landing.land_bucketed(_encoded(places.select("word").distinct(), file), buckets, "word")
    known = _decoded(words, file)
    blobs = _by_chunk(places.join(known, "word"))
    return _assembled(split.select(*[F.col(f"`{c}`") for c in kept], _CHUNK, _NUMBERS), blobs, kept, columns)


def decode(df: DataFrame, file: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default all but a column `decoded`) and the text that a column of ids
    decodes to (null: an empty text), by a join of ids with pieces; a row's pieces meet by its number."""
    landing = Landing(df.sparkSession, "byte-pairs")
    kept = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    rows = landing.land(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("__ids"), F.monotonically_increasing_id().alias("__row")))
    places = rows.select(F.col("__row"), F.posexplode("__ids").alias("at", "id")).join(piece_table(df.sparkSession, file), "id")
    texts = places.groupBy("__row").agg(_joined(F.collect_list(F.struct("at", "piece"))).alias("__bytes"))
    joined = rows.join(texts, "__row", "left")
    decoded = F.make_valid_utf8(F.coalesce("__bytes", F.lit(b"")).cast("string"))
    return joined.select(*[F.col(f"`{c}`") for c in kept], decoded.alias("decoded"))

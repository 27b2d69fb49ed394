"""Hard negatives of anchors by a secondary sort of scored pairs.

1. Rows and anchors are dealt to cells, a block of rows by a block of anchors each.  A cell
   scores its pairs and tells each anchor's best rows of its own label; the first
   `positives` of all cells are the anchor's positives, and each opens a window of scores.
2. A second pass over the cells tells, for each window, the cell's best rows of other labels
   that lie in it: no other row of the cell can be among the window's first.
3. Positives and these rows become pairs under packed keys (anchor, descending score, role,
   id, row).  `repartitionAndSortWithinPartitions` brings an anchor's pairs together in that
   order, and an iterator opens a window at each positive and gives out negatives until the
   window has enough.  It holds an anchor's open windows and nothing else.

What is shuffled for an anchor grows with the number of row blocks, not of rows, and no
label, id or vector is a key, so none can be hot.

Scores are exact integers: products that a double can't hold are made with Python's integers,
and a score beyond a long is cut to the ends of a long.

Defined cases: a row with a null id, label or vector, or with a null or non-finite component,
takes no part; vectors of different lengths have no score; an empty vector scores 0 with its
like; rows that share an id are rows of their own (ties of score and id go by the order in
which the table was read); an anchor without positives, and a positive without negatives,
give no row; a positive of score 0 takes negatives of score 0, one below takes none; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkfold.llm.landing import Landing


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 10
    low: int = 30  # percent of the positive's score that a negative has at least
    high: int = 90  # ... and at most
    scale: int = 256
    anchor_block: int = 4096
    row_block: int = 16384


CELL = ["size", "a", "r"]
_LONG = (1 << 63) - 1
#: (anchor row, descending score, role, id, row); unsigned and big-endian, so that bytes sort.
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("role", "u1"), ("id", ">u8"), ("row", ">u8")])
_UNPACK = struct.Struct(">QQBQQ").unpack
_SIGN = 1 << 63
POSITIVE, NEGATIVE = 0, 1


def _points(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """Rows (id, label, v, size) of the vectors that take part."""
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & v.isNotNull() & whole
    rows = vectors.filter(F.coalesce(usable, F.lit(False)))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("string").alias("label"), v.alias("v"), F.size(v).alias("size"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles if all scores of such rows are exact in doubles, else Python's integers."""
    with np.errstate(over="ignore"):
        q = np.floor(x * scale)
    if not q.size or np.abs(q).max() < np.sqrt(2**53 / q.shape[1]):
        return q
    return np.array([[int(c) * scale if abs(c) > 2**53 else int(np.floor(c * scale)) for c in row] for row in x.tolist()], object)


def scores(anchors: np.ndarray, rows: np.ndarray, scale: int) -> np.ndarray:
    """Integer inner products, a line for each anchor."""
    if not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    q = _scaled(np.concatenate((anchors, rows)), scale)
    found = q[: len(anchors)] @ q[len(anchors) :].T
    if found.dtype == object:
        found = np.array([[max(-_LONG - 1, min(_LONG, s)) for s in line] for line in found.tolist()], object)
    return found.astype(np.int64)


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by place."""
    at = np.arange(len(score))
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.argsort(-score[at], kind="stable")[:k]]


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("id", "ascending"), ("row", "ascending")])


def _steps(n_anchors: int, n_rows: int) -> Iterator[slice]:
    """Anchors whose scores are held at once."""
    step = max(1, (1 << 21) // max(1, n_rows))
    return (slice(i, i + step) for i in range(0, n_anchors, step))


PAIRS = "anchor long, anchor_id long, score long, id long, row long"


def _pairs(anchor: list, anchor_id: list, score: list, ids: list, row: list) -> pa.Table:
    def flat(parts: list) -> pa.Array:
        return pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())

    return pa.table({"anchor": flat(anchor), "anchor_id": flat(anchor_id), "score": flat(score), "id": flat(ids), "row": flat(row)})


def _cells(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int]):
    """Each block of anchors with each block of rows.  Both sides of a cell are bounded."""
    n_a, n_r = blocks
    ahead = rows.withColumn("r", F.pmod(F.xxhash64("row"), F.lit(n_r)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))))
    asked = anchors.withColumn("a", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_a)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    return asked.groupBy(*CELL).cogroup(ahead.groupBy(*CELL))


def _best_positives(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], how: Mining) -> DataFrame:
    """The positives of each anchor: its first rows of the same label."""

    def run(asked: pa.Table, ahead: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        ahead = _in_order(ahead)
        label, own = (t.column("label").to_numpy(zero_copy_only=False) for t in (ahead, asked))
        for name in sorted(set(own.tolist()) & set(label.tolist())):
            those, these = ahead.filter(pa.array(label == name)), asked.filter(pa.array(own == name))
            ids, row = those.column("id").to_numpy(), those.column("row").to_numpy()
            me, my_id = these.column("row").to_numpy(), these.column("id").to_numpy()
            x, y = _matrix(these.column("v")), _matrix(those.column("v"))
            for part in _steps(len(me), len(ids)):
                for i, line in enumerate(scores(x[part], y, how.scale), part.start):
                    at = _first(line, how.positives + 1)
                    at = at[row[at] != me[i]][: how.positives]
                    for field, values in zip(out, (np.full(len(at), me[i]), np.full(len(at), my_id[i]), line[at], ids[at], row[at]), strict=True):
                        field.append(values)
        return _pairs(*out)

    found = _cells(rows, anchors, blocks).applyInArrow(run, PAIRS)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= how.positives).drop("nth")


def _window(score: int, how: Mining) -> tuple[int, int]:
    """The lowest and the highest score of a positive's negatives."""
    return -(-how.low * score // 100), how.high * score // 100


def _best_negatives(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], how: Mining) -> DataFrame:
    """Rows of other labels that may be among the first in an anchor's windows."""

    def run(asked: pa.Table, ahead: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if asked.num_rows and ahead.num_rows:
            ahead = _in_order(ahead)
            names, codes = np.unique(np.concatenate([t.column("label").to_numpy(zero_copy_only=False).astype(str) for t in (asked, ahead)]), return_inverse=True)
            own, label = codes[: asked.num_rows], codes[asked.num_rows :]
            ids, row = ahead.column("id").to_numpy(), ahead.column("row").to_numpy()
            me, my_id = asked.column("row").to_numpy(), asked.column("id").to_numpy()
            opened = asked.column("opened").to_pylist()
            x, y = _matrix(asked.column("v")), _matrix(ahead.column("v"))
            for part in _steps(len(me), len(ids)):
                for i, line in enumerate(scores(x[part], y, how.scale), part.start):
                    windows = sorted({_window(p, how) for p in opened[i] if p >= 0})
                    if not windows:
                        continue
                    low, high = min(w[0] for w in windows), max(w[1] for w in windows)
                    near = np.flatnonzero((label != own[i]) & (line >= low) & (line <= high))
                    value, taken = line[near], []
                    for low, high in windows:
                        inside = np.flatnonzero((value >= low) & (value <= high))
                        taken.append(inside[_first(value[inside], how.negatives)])
                    at = near[np.unique(np.concatenate(taken))]
                    for field, values in zip(out, (np.full(len(at), me[i]), np.full(len(at), my_id[i]), line[at], ids[at], row[at]), strict=True):
                        field.append(values)
        return _pairs(*out)

    return _cells(rows, anchors, blocks).applyInArrow(run, PAIRS)


def _packed(pairs: DataFrame) -> DataFrame:
    """Rows (key, anchor_id) of pairs with a role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.empty(batch.num_rows, _KEY)
            for name in ("anchor", "id", "row"):
                keys[name] = batch.column(name).to_numpy().view(np.uint64) ^ np.uint64(_SIGN)
            # All bits turned, a higher score comes first.
            keys["score"] = ~batch.column("score").to_numpy().view(np.uint64) ^ np.uint64(_SIGN)
            keys["role"] = batch.column("role").to_numpy()
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([packed.cast(pa.binary()), batch.column("anchor_id")], ["key", "anchor_id"])

    return pairs.mapInArrow(run, "key binary, anchor_id long")


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(pairs: Iterator[tuple[bytes, int]], how: Mining) -> Iterator[tuple]:
    """From pairs in the order of their keys: a positive opens a window, negatives are given
    out to the open windows they lie in, and a window with enough of them is closed."""
    anchor, windows = None, []
    for key, anchor_id in pairs:
        owner, score, role, other, _ = _UNPACK(key)
        score, other = (~score & (1 << 64) - 1) - _SIGN, other - _SIGN
        if owner != anchor:
            anchor, windows = owner, []
        if role == POSITIVE:
            low, high = _window(score, how)
            if low <= high:
                windows.append([low, high, other, score, 0])
            continue
        full = False
        for window in windows:
            low, high, positive, positive_score, given = window
            if low <= score <= high:
                window[4] = given + 1
                full |= given + 1 == how.negatives
                yield anchor_id, positive, given + 1, other, positive_score, score
        if full:
            windows = [w for w in windows if w[4] < how.negatives]


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, how: Mining = Mining(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `is_anchor` is a condition on `id`; `label` a column of the table (default: label).  The
    pairs are mined when the result is used; the tables before them are written here.
    """
    spark = vectors.sparkSession
    landing = Landing(spark, "hard-negatives")
    points = _points(vectors, id_col, vector_col, F.col("label") if label is None else label)
    # A landed row keeps its number, also where a lost task runs again.
    rows = landing.land(points.withColumn("row", F.monotonically_increasing_id()))
    anchors = rows.filter(is_anchor)
    n, n_anchors = (d.count() for d in (rows, anchors))
    slots = spark.sparkContext.defaultParallelism
    blocks = (max(1, -(-n_anchors // how.anchor_block)), max(1, -(-n // how.row_block), min(slots, -(-n // 1024))))
    positives = landing.land(_best_positives(rows, anchors, blocks, how))
    opened = positives.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("opened"))
    asked = landing.land(anchors.join(opened, "row"))
    negatives = _best_negatives(rows, asked, blocks, how)
    pairs = landing.land(positives.withColumn("role", F.lit(POSITIVE)).unionByName(negatives.withColumn("role", F.lit(NEGATIVE))))
    landing.drop(rows, positives, asked)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _packed(pairs).rdd.map(lambda r: (bytes(r[0]), r[1]))
    sorted_ = keyed.repartitionAndSortWithinPartitions(parts, partitionFunc=lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(sorted_.mapPartitions(lambda part: mined(part, how)), MINED, verifySchema=False)

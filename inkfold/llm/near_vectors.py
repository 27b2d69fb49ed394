"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared only with those of the same label.  Each tree splits a node at the
median of a random projection again and again; vectors near the median go to both sides
(spill), so that a close pair is rarely torn apart in one tree and hardly ever in all.
Within leaves every pair is compared by cosine in double precision.  Each vector carries the
names of its leaves: a pair is counted in the first leaf that holds both, so links are summed
without writing pairs.  A leaf gives one row a linked vector (its links, the smallest vector
it reaches there); connected components of these rows give the groups.

Equal vectors are one point with a number of copies.  Nodes above `Forest.task_rows` are
split by Spark jobs (median by an aggregate, children by a join); smaller ones by one task
each.  A node that no projection parts (a dense ball) is one leaf; above task size it is cut
into blocks, and every pair of blocks is compared, so its size bounds no task and no pair is lost.

Defined cases: a vector that is null, all zero, empty, or holds null or non-finite
components, or whose label or id is null, links with nothing (n_links 0, its own
component); vectors of different lengths do not link; equal rows link with each other;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkfold.llm.components import connected_components
from inkfold.llm.landing import Landing


@dataclass(frozen=True)
class Forest:
    cosine: float = 0.98
    trees: int = 4
    leaf: int = 200
    task_rows: int = 4096
    spill: float = 0.8  # times what a close pair differs by on a random line
    seed: int = 7


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _margin(how: Forest, size: int) -> float:
    return how.spill * np.sqrt(max(0.0, 2 - 2 * how.cosine) / size)


def _close(x: np.ndarray, least: float) -> np.ndarray:
    """Which two rows have this cosine or more, as a matrix; no row with itself."""
    close = np.empty((len(x), len(x)), bool)
    step = max(1, (1 << 22) // max(1, len(x)))
    for i in range(0, len(x), step):
        np.greater_equal(x[i : i + step] @ x.T, least, out=close[i : i + step])
    close |= close.T
    np.fill_diagonal(close, False)
    return close


def _together(names: list[list[str]], leaf: str) -> np.ndarray:
    """Which two rows also share a leaf whose name comes before this one's."""
    members: dict[str, list[int]] = {}
    for row, its in enumerate(names):
        for name in its:
            if name < leaf:
                members.setdefault(name, []).append(row)
    shared = np.zeros((len(names), len(names)), bool)
    for rows in members.values():
        if len(rows) > 1:
            shared[np.ix_(rows, rows)] = True
    return shared


def _roots(close: np.ndarray) -> np.ndarray:
    """For each row the first row that links reach from it."""
    root = np.arange(len(close))
    left = close.any(axis=1)
    for start in range(len(close)):
        if not left[start]:
            continue
        left[start], new = False, np.array([start])
        while len(new):
            new = np.flatnonzero(close[new].any(axis=0) & left)
            left[new], root[new] = False, start
    return root


def _tree_leaves(x: np.ndarray, how: Forest, seed: int) -> list[np.ndarray]:
    """The leaves of one random tree over the rows of x: places of rows, some in several."""
    random, size = np.random.default_rng(seed), x.shape[1]
    margin = _margin(how, size)
    leaves, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        left = right = rows
        if len(rows) > how.leaf:
            lines = random.standard_normal((size, 4)) / np.sqrt(size)
            values = x[rows] @ lines
            value = values[:, values.std(axis=0).argmax()]
            middle = np.median(value)
            left, right = rows[value <= middle + margin], rows[value > middle - margin]
        if max(len(left), len(right)) > 0.9 * len(rows):  # small enough, or a dense ball
            leaves.append(rows)
        else:
            todo += [left, right]
    return leaves


def _points(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows (id, label, v), v null where the vector links with nothing."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = v.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & whole & F.exists(v, lambda c: c != 0)
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))


def _split(nodes: DataFrame, large: DataFrame, how: Forest, level: int, landing: Landing) -> tuple[DataFrame, DataFrame]:
    """Children of the nodes above task size, and the nodes that their projection does not part."""
    key = ["label", "size", "tree", "path"]
    seed = how.seed

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy(zero_copy_only=False)
            tree = batch.column("tree").to_numpy(zero_copy_only=False)
            value = np.zeros(batch.num_rows)
            vectors = batch.column("v")
            for s, t in sorted(set(zip(size.tolist(), tree.tolist(), strict=True))):
                rows = np.flatnonzero((size == s) & (tree == t))
                line = np.random.default_rng((seed, level, t, s)).standard_normal(s) / np.sqrt(s)
                value[rows] = _unit(_matrix(vectors.take(pa.array(rows)))) @ line
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, "value"])

    rows = nodes.join(large.select(*key), key)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    valued = landing.land(rows.mapInArrow(project, f"{fields}, value double"))
    middle = valued.groupBy(*key).agg(F.percentile_approx("value", 0.5, 1000).alias("middle"), F.count(F.lit(1)).alias("n"))
    margin = F.sqrt(F.lit(max(0.0, 2 - 2 * how.cosine)) / F.col("size")) * how.spill
    near = valued.join(middle, key)
    sides = F.filter(F.array(
        F.when(F.col("value") <= F.col("middle") + margin, F.lit("0")),
        F.when(F.col("value") > F.col("middle") - margin, F.lit("1")),
    ), lambda s: s.isNotNull())
    dealt = landing.land(near.withColumn("side", F.explode(sides)))
    most = dealt.groupBy(*key, "side").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    dense = most.groupBy(*key).agg(F.max(F.col("m") / F.col("n")).alias("share")).filter(F.col("share") > 0.9).select(*key)
    split = dealt.join(dense, key, "left_anti").withColumn("path", F.concat("path", "side"))
    return split.select(*nodes.columns), rows.join(dense, key).select(*nodes.columns)


def _small_nodes(nodes: DataFrame, how: Forest) -> DataFrame:
    """Rows (label, size, gid, leaf) of nodes that one task splits."""
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("gid").to_numpy())
        ids = group.column("gid").to_numpy()[order].astype(np.int64)
        tree, path = group.column("tree")[0].as_py(), group.column("path")[0].as_py()
        seed = hash((how.seed, tree, int(ids[0]) & 0xFFFFFF))
        leaves = _tree_leaves(_unit(_matrix(group.column("v")))[order], how, abs(seed) % (1 << 32))
        rows = np.concatenate(leaves)
        names = np.repeat([f"{tree:03d}.{path}.{n}" for n in range(len(leaves))], [len(r) for r in leaves])
        first = pa.array(np.zeros(len(rows), np.int64))
        return pa.table({"label": group.column("label").take(first), "size": group.column("size").take(first), "gid": ids[rows], "leaf": names.tolist()})

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.groupBy("label", "size", "tree", "path").applyInArrow(run, f"label {kind}, size int, gid long, leaf string")


def _leaves_of_trees(points: DataFrame, how: Forest, landing: Landing) -> DataFrame:
    """Rows (label, size, gid, leaf): the leaves of each point, the name of one beginning with its tree's number."""
    key = ["label", "size", "tree", "path"]
    nodes = points.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(how.trees - 1)))).withColumn("path", F.lit(""))
    found, level = None, 0
    while True:
        counts = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        large = landing.land(counts.filter(F.col("n") > how.task_rows))
        whole = large.isEmpty()
        done = _small_nodes(nodes if whole else nodes.join(large.select(*key), key, "left_anti"), how)
        found = done if found is None else found.unionByName(done)
        if whole:
            return landing.land(found)
        nodes, dense = _split(nodes, large, how, level, landing)
        nodes, dense = landing.land(nodes), landing.land(dense)
        ball = F.format_string("%03d.%s.ball", "tree", "path").alias("leaf")
        found = found.unionByName(dense.select("label", "size", F.col("gid").cast("long").alias("gid"), ball))
        level += 1


def _links(points: DataFrame, leaves: DataFrame, how: Forest, landing: Landing) -> DataFrame:
    """Rows (u, n, root) of points linked within a leaf: the copies they link with there and
    in no leaf before, and the smallest point they reach."""
    key = ["label", "size", "leaf"]
    # A point stands in a few leaves of each tree.
    of = leaves.groupBy("gid").agg(F.collect_list("leaf").alias("leaves"))
    large = leaves.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > how.task_rows)
    large = large.select(*key, F.ceil(F.col("n") * 2 / how.task_rows).cast("int").alias("blocks"))
    rows = points.join(of, "gid").withColumn("leaf", F.explode("leaves")).join(large, key, "left")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("gid"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    rows = rows.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("gid").to_numpy().astype(np.int64)
        order = np.argsort(ids)
        ids, block = ids[order], group.column("block").to_numpy()[order]
        group = group.select(["v", "leaves", "copies", "leaf"]).take(pa.array(order))
        close = _close(_unit(_matrix(group.column("v"))), how.cosine)
        if block.min() != block.max():  # two blocks: pairs within one are counted elsewhere
            close &= block[:, None] != block[None, :]
        linked = np.flatnonzero(close.any(axis=1))
        close = close[np.ix_(linked, linked)]
        group = group.take(pa.array(linked))
        first = close & ~_together(group.column("leaves").to_pylist(), group.column("leaf")[0].as_py()) if len(linked) else close
        n = first.astype(np.float64) @ group.column("copies").to_numpy().astype(np.float64)  # whole numbers: exact
        return pa.table({"u": ids[linked], "n": n.astype(np.int64), "root": ids[linked][_roots(close)]})

    return landing.land(rows.groupBy(*key, "i", "j").applyInArrow(run, "u long, n long, root long"))


def near_vectors(
    vectors: DataFrame, how: Forest = Forest(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row a vector: id, n_links (other vectors linked directly), component_id (smallest
    id reachable, itself included) and kept (it is that smallest one)."""
    landing = Landing(vectors.sparkSession, "near-vectors")
    rows = _points(vectors, id_col, vector_col, label_col)
    usable = rows.filter(F.col("v").isNotNull())
    # One point for equal vectors; a hot vector is combined before the shuffle.
    points = landing.land(usable.groupBy("label", "v").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("copies")).withColumn("size", F.size("v")))
    leaves = _leaves_of_trees(points.select("gid", "label", "size", "v"), how, landing)
    found = _links(points, leaves, how, landing)
    linked = found.groupBy("u").agg(F.sum("n").alias("more"))
    parts = connected_components(found.select("u", F.col("root").alias("v")), landing)
    info = (
        points.select("gid", "label", "v", "copies")
        .join(linked.withColumnRenamed("u", "gid"), "gid", "left")
        .join(parts.withColumnRenamed("id", "gid"), "gid", "left")
        .select(
            F.col("label").alias("point_label"), F.col("v").alias("point_v"),
            (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
            F.coalesce("component", "gid").alias("component_id"),
        )
    )
    same = (F.col("label") == F.col("point_label")) & (F.col("v") == F.col("point_v"))
    joined = rows.join(info, same, "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("id") == component).alias("kept"),
    )

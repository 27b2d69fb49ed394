"""Exact Jaccard join of texts on word shingles, with signature trees.

1. Texts with equal shingle sets are one member (the smallest id), by an aggregate.
2. Members that can be similar share a shingle of their prefixes: with shingles in one
   common order, the first n - ceil(t n) + 1.  Common shingles come last in that order
   (a sketch of counts over all texts names them), so passages of many texts seldom stand in
   a prefix.  Any order gives the same result.
3. Each shared shingle has a hub, its smallest member; members are compared with their hubs
   only, and what is similar becomes a component.  Large groups of copies are joined
   here without comparing all their pairs.
4. Where a shingle still joins several components, its members go into signature trees: a
   node holds the OR of its members' shingle bitmaps and their range of sizes.  Two trees
   are walked together; a pair of nodes is dropped if its greatest possible overlap is too
   small, or if both hold only one and the same component.  Pairs of members that are left
   are compared exactly.  A large group is cut into blocks, a task for each pair of blocks.

The links so found connect all texts that any chain of similar texts connects.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case.  Fewer words than a shingle has are one
shingle.  Defined cases: a text that is null or has no word has no shingle and links
with nothing, also not with its like; a null id links with nothing; rows with the same
id are one document, and the links of all their texts are united; an empty table gives an
empty table.  Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkfold.llm.components import connected_components
from inkfold.llm.landing import Landing
from inkfold.llm.mapping import map_texts, text_chunks
from inkfold.llm.words import mix, range_hashes, split_words, window_hashes

BITS = 1024
#: Pairs of nodes that are looked at together; each may become fan * fan of them.
_PAIRS = 1 << 13


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80  # of the union that the intersection must have
    block: int = 2048  # members of a tree at most
    deal: int = 256  # members of a shingle that a task deals to blocks
    fan: int = 8  # children of a node
    sketch_bits: int = 22  # counters of a task; more for more text
    common: int = 1 << 17  # names of common shingles that are broadcast at most
    filter_bits: int = 23  # of the filter that spares shingle sets nobody asks for


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, by text then hash, and the number of the text."""
    words = split_words(texts, lower=True)
    hashes = range_hashes(words.buffer, words.start, words.end)
    found, at = window_hashes(hashes, words.text, size)
    owner = words.text[at]
    counts = words.counts
    for few in range(1, size):
        short = np.flatnonzero(counts == few)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(few):
                whole = mix(whole * np.uint64(0x9FB21C651E98DF25) + hashes[words.first[short] + k] + np.uint64(k + 101))
            found, owner = np.concatenate((found, whole)), np.concatenate((owner, short))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


def _common(df: DataFrame, text: str, how: Join) -> np.ndarray:
    """Sketch counters of shingles that many texts have, the rarest first.

    Each task counts in a table of fixed size and tells only counters far above the mean;
    Spark adds them up.  This decides the order of shingles, not the result."""
    counters = 1 << how.sketch_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(counters, np.int32)
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0)):
                found, _ = shingles(texts, how.words)
                np.add.at(table, (found >> np.uint64(64 - how.sketch_bits)).astype(np.int64), 1)
        high = np.flatnonzero(table > max(7.0, 4 * table.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(table[high].astype(np.int64))], ["counter", "n"])

    told = df.select(F.col(f"`{text}`").cast("binary")).mapInArrow(run, "counter long, n long")
    top = told.groupBy("counter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "counter").limit(how.common)
    return np.array([r["counter"] for r in top.collect()][::-1], np.int64)


#: What tells a set from others: its size and two sums of 64 bits.
KEY = ["n", "sum", "mix"]


def _digests(found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers that tell each of the sets, which stand one after another."""
    total, other = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        first = (np.cumsum(n) - n)[full]
        total[full] = np.add.reduceat(mix(found), first)
        other[full] = np.bitwise_xor.reduceat(mix(found + np.uint64(0x632BE59BD9B4E019)), first)
    return total.view(np.int64), other.view(np.int64)


SIGNED = "n long, sum long, mix long, prefix array<long>, bits binary"


def _wide_bitmaps(found: np.ndarray, owner: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A bitmap of each set: a power of two that is twice the set's size, BITS at least."""
    bits = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(1, 2 * n))).astype(np.int64))
    base = np.concatenate((np.zeros(1, np.int64), np.cumsum(bits)))
    table = np.zeros(base[-1], bool)
    table[base[owner] + (found.view(np.int64) & (bits[owner] - 1))] = True
    packed = np.packbits(table).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1], base[1:], strict=True)]


def _apart(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """Of each pair of wide bitmaps, how many bits differ: no more than shingles do."""
    out = np.zeros(len(one), np.int64)
    sizes = np.array([(len(a), len(b)) for a, b in zip(one, other, strict=True)], np.int64).reshape(-1, 2)
    for x, y in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes[:, 0] == x) & (sizes[:, 1] == y))
        for at in range(0, len(rows), max(1, (1 << 22) // int(x))):
            part = rows[at : at + max(1, (1 << 22) // int(x))]
            a = np.frombuffer(b"".join(one[i] for i in part), np.uint8).reshape(len(part), x)
            b = np.frombuffer(b"".join(other[i] for i in part), np.uint8).reshape(len(part), y)
            while a.shape[1] > b.shape[1]:
                a = a[:, : a.shape[1] // 2] | a[:, a.shape[1] // 2 :]
            while b.shape[1] > a.shape[1]:
                b = b[:, : b.shape[1] // 2] | b[:, b.shape[1] // 2 :]
            out[part] = _COUNT(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def _signatures(df: DataFrame, id_col: str, text: str, how: Join, common: np.ndarray) -> DataFrame:
    """Of each row: size of its set, two numbers that tell the set, prefix, bitmap."""
    counters = np.sort(common)
    rank = np.argsort(common).astype(np.int64) + 1  # of each counter in sorted order

    def make():
        place = np.zeros(1 << how.sketch_bits, np.int32)
        place[counters] = rank

        def call(texts: list[bytes]) -> dict:
            found, owner = shingles(texts, how.words)
            n = np.bincount(owner, minlength=len(texts))
            first = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
            total, other = _digests(found, n)
            order = np.lexsort((found, place[(found >> np.uint64(64 - how.sketch_bits)).astype(np.int64)], owner))
            length = np.where(n > 0, n - _least(n, how.percent) + 1, 0)
            inside = np.arange(len(found)) - first[owner] < length[owner]
            offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(length))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[order][inside].view(np.int64)))
            return {"n": n, "sum": total, "mix": other, "prefix": prefix, "bits": _wide_bitmaps(found, owner, n)}

        return call

    return map_texts(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")), make, SIGNED)


def _filter_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit table of fixed size that holds the ids, for sparing work; the joins decide."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = ids.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("held"))
    table = np.zeros(1 << bits >> 6, np.int64)
    for row in words.toLocalIterator():  # at most 2 ** (bits - 6) rows
        table[row["word"]] = row["held"]
    return table


def _sets(df: DataFrame, id_col: str, text: str, how: Join, wanted: DataFrame) -> DataFrame:
    """Shingle sets (id, set) of the wanted classes (member, doc, n, sum, mix), from the texts
    of their smallest ids; a text that is not the class's has another digest.  Texts are not shuffled."""
    docs = wanted.select(F.col("doc").alias("id"))
    held = df.sparkSession.sparkContext.broadcast(_filter_of(docs, how.filter_bits))
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << how.filter_bits))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")).filter(F.col("id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            slots = batch.column(2).to_numpy()
            asked = (table[slots >> 6] >> (slots & 63)) & 1 == 1
            for _, _, texts in text_chunks(batch.column(1).filter(pa.array(asked))):
                found, owner = shingles(texts, how.words)
                n = np.bincount(owner, minlength=len(texts))
                total, other = _digests(found, n)
                offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(n))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(total), pa.array(other), sets], [*KEY, "set"])

    found = rows.withColumn("slot", slot).mapInArrow(run, "n long, sum long, mix long, set array<long>").dropDuplicates(KEY)
    return found.join(wanted, KEY).select(F.col("member").alias("id"), "set")


def _similar(both: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * both >= percent * (a + b - both)


def _verified(pairs: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    one = pairs.join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v")
    two = one.join(sets.select(F.col("id").alias("u"), F.col("set").alias("su")), "u")
    both = F.size(F.array_intersect("su", "sv")).cast("long")
    return two.filter(_similar(both, F.size("su"), F.size("sv"), how.percent)).select("u", "v")


_COUNT = np.bitwise_count


def _possible(pairs: DataFrame, members: DataFrame, how: Join) -> DataFrame:
    """The pairs (u, v) that sizes and bitmaps do not rule out."""
    info = members.select("id", "n", "bits")
    joined = pairs.join(info.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu")), "u")
    joined = joined.join(info.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv")), "v")
    joined = joined.filter(_similar(F.least("nu", "nv"), F.col("nu"), F.col("nv"), how.percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = _apart(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            both = (n - apart) // 2
            keep = pa.array(100 * both >= how.percent * (n - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return joined.select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(run, "u long, v long")


def _folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps of BITS bits each: the halves of larger ones are laid over each other."""
    out = np.empty((len(bitmaps), BITS // 8), np.uint8)
    sizes = np.array([len(b) for b in bitmaps], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        table = np.frombuffer(b"".join(bitmaps[i] for i in rows), np.uint8).reshape(len(rows), -1, BITS // 8)
        out[rows] = np.bitwise_or.reduce(table, axis=1)
    return out.view(np.uint64)


class Tree:
    """Levels of nodes over members in order; a node's children are neighbours."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, group: np.ndarray, fan: int):
        excess = n - _COUNT(bits).sum(axis=1, dtype=np.int64)  # shingles that share a bit
        self.fan = fan
        self.levels = [(bits, n, n, group, group, excess)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, g_low, g_high, e = self.levels[-1]
            at = np.arange(0, len(low), fan)
            self.levels.append((
                np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.minimum.reduceat(g_low, at), np.maximum.reduceat(g_high, at), np.maximum.reduceat(e, at)))


def _may_match(one: Tree, other: Tree, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a member below node a and one below node b can be similar and are not yet joined."""
    bits, low, high, g_low, g_high, excess = one.levels[level]
    bits2, low2, high2, g_low2, g_high2, excess2 = other.levels[level]
    joined = (g_low[a] == g_high[a]) & (g_low2[b] == g_high2[b]) & (g_low[a] == g_low2[b])
    sizes = (100 * high[a] >= percent * low2[b]) & (100 * high2[b] >= percent * low[a])
    keep = np.flatnonzero(sizes & ~joined)
    a, b = a[keep], b[keep]
    least = low[a] + low2[b]
    if level == 0:
        both = (least - _COUNT(bits[a] ^ bits2[b]).sum(axis=1, dtype=np.int64)) // 2
    else:
        both = _COUNT(bits[a] & bits2[b]).sum(axis=1, dtype=np.int64) + np.minimum(excess[a], excess2[b])
    out = np.zeros(len(sizes), bool)
    out[keep[(100 + percent) * both >= percent * least]] = True
    return out


def _dual_walk(one: Tree, other: Tree, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members that survive; trees of equal height (the lower one is grown by its root)."""
    while len(one.levels) < len(other.levels):
        one.levels.append(one.levels[-1])
    while len(other.levels) < len(one.levels):
        other.levels.append(other.levels[-1])
    left, right = [], []
    todo = [(len(one.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        if len(a) > _PAIRS:
            todo += [(level, a[i : i + _PAIRS], b[i : i + _PAIRS]) for i in range(0, len(a), _PAIRS)]
            continue
        ok = _may_match(one, other, level, a, b, percent)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if level == 0:
            left.append(a)
            right.append(b)
            continue
        a, b = _children(one, level, a, b, 0), _children(other, level, a, b, 1)
        inside = (a < len(one.levels[level - 1][1])) & (b < len(other.levels[level - 1][1]))
        if same:
            inside &= (a < b) if level == 1 else (a <= b)
        todo.append((level - 1, a[inside], b[inside]))
    empty = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _children(tree: Tree, level: int, a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    fan = tree.fan
    k = np.arange(fan * fan)
    step = k // fan if which == 0 else k % fan
    node = a if which == 0 else b
    if len(tree.levels[level][1]) == len(tree.levels[level - 1][1]):  # a root set over itself
        return np.where(step == 0, node[:, None], 1 << 40).ravel()
    return (node[:, None] * fan + step).ravel()


def _left_over(shared: DataFrame, parts: DataFrame, members: DataFrame, how: Join, landing: Landing) -> DataFrame:
    """Pairs (u, v) of different components that share a shingle, from signature trees."""
    named = shared.join(parts.withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    groups = named.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min("part").alias("low"), F.max("part").alias("high"),
        F.max(F.when(F.col("id") == F.col("hub"), F.col("part"))).alias("main"),
        F.count(F.when(F.col("id") == F.col("hub"), 1)).alias("hubs"),
        F.bit_xor(F.xxhash64("id")).alias("which"), F.min("hub").alias("hub"))
    # Pairs with the hub have been compared, so two members are done; tokens of equal groups count once.
    open_ = groups.filter((F.col("low") != F.col("high")) & (F.col("size") > 2))
    one_each = open_.groupBy("size", "which", "hub", "main").agg(F.min("token").alias("token")).select("token", "main", "size")
    rows = named.join(one_each, "token").filter(F.col("id") != F.col("hub")).select("token", "size", "id", "part", (F.col("part") != F.col("main")).alias("apart"))
    rows = landing.land(rows)
    # A token of many members is dealt in parts from here on.
    parts_of = F.ceil(F.col("size") / how.deal).cast("int")
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("id", F.lit(2)), parts_of).cast("int"))
    blocks = rows.groupBy("token", "size").agg(
        F.ceil(F.count(F.when(F.col("apart"), 1)) / how.block).cast("int").alias("n_apart"),
        F.ceil(F.count(F.when(~F.col("apart"), 1)) / how.block).cast("int").alias("n_main"))
    blocks = blocks.filter(F.col("n_apart") > 0).withColumn("deal", F.explode(F.sequence(F.lit(0), parts_of - 1)))
    dealt = rows.join(blocks.drop("size"), ["token", "deal"])
    block = F.pmod(F.xxhash64("id"), F.when(F.col("apart"), F.col("n_apart")).otherwise(F.col("n_main"))).cast("int")
    dealt = dealt.withColumn("block", block)

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    # A task (i, j, main): a block apart with a block of the main component, or two blocks apart.
    with_main = F.when(F.col("apart"), F.transform(upto(F.col("n_main")), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("main"))))
    with_main = with_main.otherwise(F.transform(upto(F.col("n_apart")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(True).alias("main"))))
    with_apart = F.when(F.col("apart"), F.transform(upto(F.col("n_apart")), lambda k: F.struct(
        F.least("block", k).alias("i"), F.greatest("block", k).alias("j"), F.lit(False).alias("main"))))
    tasks = F.concat(with_main, F.coalesce(with_apart, F.array().cast("array<struct<i:int,j:int,main:boolean>>")))
    info = members.select("id", "n", "bits")
    placed = dealt.withColumn("task", F.explode(tasks)).select("token", "task.*", "id", "part", "apart", "block")
    placed = placed.join(info, "id")

    def run(group: pa.Table) -> pa.Table:
        main = group.column("main")[0].as_py()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        ids, n, part = (group.column(c).to_numpy() for c in ("id", "n", "part"))
        wide = group.column("bits").to_pylist()
        bits = _folded(wide)
        first = group.column("apart").to_numpy() if main else group.column("block").to_numpy() == i
        same = not main and i == j

        def tree(rows: np.ndarray) -> tuple[Tree, np.ndarray]:
            order = rows[np.lexsort((bits[rows, 0], n[rows], part[rows]))]
            return Tree(bits[order], n[order], part[order], how.fan), order

        sides = [np.flatnonzero(first), np.flatnonzero(first if same else ~first)]
        if not len(sides[0]) or not len(sides[1]):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        one, rows_one = tree(sides[0])
        other, rows_other = (one, rows_one) if same else tree(sides[1])
        a, b = _dual_walk(one, other, same, how.percent)
        a, b = rows_one[a], rows_other[b]
        # Bitmaps of one size fill up with long texts; those that grow with the text do not.
        keep = np.zeros(len(a), bool)
        for at in range(0, len(a), _PAIRS):
            x, y = a[at : at + _PAIRS], b[at : at + _PAIRS]
            both = (n[x] + n[y] - _apart([wide[i] for i in x], [wide[i] for i in y])) // 2
            keep[at : at + _PAIRS] = 100 * both >= how.percent * (n[x] + n[y] - both)
        u, v = ids[a[keep]], ids[b[keep]]
        return pa.table({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    found = placed.groupBy("token", "i", "j", "main").applyInArrow(run, "u long, v long")
    return found.filter(F.col("u") != F.col("v")).distinct()


def _one_document(placed: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of an id whose rows have several texts."""
    of_id = placed.filter("member is not null").groupBy("id").agg(F.min("member").alias("u"), F.max("member").alias("last"))
    several = of_id.filter(F.col("u") != F.col("last")).select("id", "u")
    return placed.join(several, "id").select("u", F.col("member").alias("v")).filter(F.col("u") != F.col("v")).distinct()


def similar_texts(df: DataFrame, how: Join = Join(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row: id, n_shingles and component_id (smallest id reachable by links)."""
    landing = Landing(df.sparkSession, "similar-texts")
    signed = landing.land(_signatures(df, id_col, text, how, _common(df, text, how)))
    usable = signed.filter((F.col("n") > 0) & F.col("id").isNotNull())
    # A class has a number of its own: its smallest id may be that of another class too.
    # Numbers follow those ids, so that a hub is the oldest text of its group.
    numbered = usable.groupBy(*KEY).agg(F.min("id").alias("doc")).orderBy("doc", *KEY)
    classes = landing.land(numbered.withColumn("member", F.monotonically_increasing_id()))
    heads = classes.select(F.col("doc").alias("id"), *KEY, "member")
    members = signed.join(heads, ["id", *KEY]).select(F.col("member").alias("id"), "n", "prefix", "bits")
    # Only shingles that two members have in their prefixes matter.
    postings = landing.land(members.select("id", F.explode("prefix").alias("token")))
    hubs = postings.groupBy("token").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter(F.col("hub") != F.col("last"))
    shared = landing.land(postings.join(hubs.select("token", "hub"), "token").distinct())
    landing.drop(postings)
    asked = shared.select("id").distinct()
    bitmaps = landing.land(members.select("id", "n", "bits").join(asked, "id", "left_semi").dropDuplicates(["id"]))
    pairs = shared.filter(F.col("id") != F.col("hub")).select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("u").alias("member")).unionByName(pairs.select(F.col("v").alias("member"))).distinct()
        return landing.land(_sets(df, id_col, text, how, landing.land(classes.join(ends, "member", "left_semi"))))

    first = landing.land(_possible(pairs, bitmaps, how))
    sets = sets_of(first)
    links = landing.land(_verified(first, sets, how))
    parts = landing.land(connected_components(links, landing))
    landing.drop(sets, first)
    more = landing.land(_left_over(shared, parts, bitmaps, how, landing))
    sets = sets_of(more)
    placed = landing.land(signed.select("id", *KEY).join(classes.select(*KEY, "member"), KEY, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("member")).alias("member")))
    # The components found so far stand for their links.
    linked = parts.select(F.col("id").alias("u"), F.col("component").alias("v"))
    linked = linked.unionByName(_verified(more, sets, how)).unionByName(_one_document(placed))
    components = landing.land(connected_components(linked, landing))
    landing.drop(sets, more, shared, bitmaps, parts, links, signed)
    named = classes.select("member", "doc").join(components.withColumnRenamed("id", "member"), "member", "left")
    named = named.select("member", "doc", F.coalesce("component", "member").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    out = placed.join(named.join(smallest, "component").select("member", "component_id"), "member", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

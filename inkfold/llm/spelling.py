"""Groups of words that are spelling variants, by an index of variable-length grams.

1. Words are counted over all texts, partly in each task, then by Spark.
2. The gram dictionary: all grams of `shortest` code points, and a longer one where what it
   lengthens is frequent.  How frequent is the lowest power of two that keeps the dictionary
   within `grams`, so that it may be broadcast.  Words are padded, so that their ends are grams.
3. A word is decomposed: from each place the longest gram of the dictionary, without those that
   lie inside one before.  One edit at a place can affect only grams within `longest` - 1 places
   of it; the largest number that any place affects bounds the grams a near word may lack.
4. List merging: by that bound, two near words share one of the bound + 1 rarest grams of both,
   at the same place, or one further in a word that is one longer.  So only these are posted, by
   gram, length and place; a pair that meets is dropped if the grams it lacks (a bit for each)
   are more than either word's bound, and the others are verified by edit distance.
5. Each word's commonest near word is its form; forms are followed by pointer jumping.

The bound never reaches all grams of a word of two code points or more, so there is no word
that the index can't find.  Only verified pairs leave the join, and Spark splits a gram that
very many words share.

Defined cases: a text that is null or has no letters has no words; a null id counts as an
empty one where slips are chosen; repeated rows count again; words that are equally frequent
go by code points; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkfold.llm.landing import Landing

# The letters of a word, A-Z in lower case beforehand.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BEGIN, _END = "\x01", "\x02"
#: Words that a task counts before it tells their numbers.
HELD_WORDS = 400_000


@dataclass(frozen=True)
class Grams:
    shortest: int = 2
    longest: int = 5
    frequent: int = 16  # words with a gram, at least, for longer ones to be kept
    grams: int = 1 << 18  # of the dictionary at most, beside the shortest


def slipped(run: str, start: int, slips: int) -> str:
    """A run as it counts: where `slips` divides the checksum of id and run, without one code point."""
    if slips:
        h = zlib.crc32(run.encode(), start)
        if h % slips == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def _told(counts: Counter, name: str = "word") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], [name, "n"])


def count_words(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", least_length: int = 5, least_count: int = 3, slips: int = 0
) -> DataFrame:
    """Rows (word, n) of the words with so many code points and occurrences at least.  With
    `slips`, one in so many (id, run) loses a code point."""
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                data = texts[i].as_py()
                if not data:
                    continue
                start = zlib.crc32(f"{ids[i].as_py()}:".encode())
                found = Counter(RUN.findall(data.lower().decode("utf-8", "replace")))
                for word, n in found.items():
                    word = slipped(word, start, slips)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield _told(counts)
                    counts = Counter()
        if counts:
            yield _told(counts)

    told = rows.mapInArrow(run, "word string, n long")
    return told.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _padded(word: str, longest: int) -> str:
    return _BEGIN * (longest - 1) + word + _END * (longest - 1)


def _gram_counts(words: DataFrame, how: Grams) -> DataFrame:
    """Rows (gram, n): in how many places of all words each gram stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                s = _padded(word, how.longest)
                for size in range(how.shortest, how.longest + 1):
                    counts.update([s[i : i + size] for i in range(len(s) - size + 1)])
                if len(counts) > HELD_WORDS:
                    yield _told(counts, "gram")
                    counts = Counter()
        if counts:
            yield _told(counts, "gram")

    return words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _dictionary(words: DataFrame, how: Grams, landing: Landing) -> dict[str, int]:
    """The kept grams, each with its place in the order of frequency, the rarest first."""
    counts = landing.land(_gram_counts(words, how))
    shorter = counts.select(F.col("gram").alias("stem"), F.col("n").alias("of_stem"))
    longer = counts.filter(F.length("gram") > how.shortest).withColumn("stem", F.expr("left(gram, length(gram) - 1)")).join(shorter, "stem")
    longer = landing.land(longer.filter(F.col("of_stem") >= how.frequent).select("gram", "n", F.floor(F.log2("of_stem")).alias("level")))
    kept, level = 0, 64
    for row in longer.groupBy("level").count().orderBy(F.desc("level")).collect():  # 64 rows at most
        if kept + row["count"] > how.grams:
            break
        kept, level = kept + row["count"], row["level"]
    grams = counts.filter(F.length("gram") == how.shortest).select("gram", "n")
    grams = grams.unionByName(longer.filter(F.col("level") >= level).select("gram", "n"))
    found = sorted((r["n"], r["gram"]) for r in grams.collect())
    landing.drop(counts, longer)
    return {gram: i for i, (_, gram) in enumerate(found)}


def decomposed(word: str, rank: dict[str, int], how: Grams) -> tuple[list[tuple[int, int, int]], int]:
    """The word's grams (rank, place, size) by place, and how many one edit can affect."""
    s, top = _padded(word, how.longest), how.longest
    grams, end = [], 0
    for at in range(len(s) - how.shortest + 1):
        size = how.shortest
        while size < top and at + size < len(s) and s[at : at + size + 1] in rank:
            size += 1
        if at + size > end and s[at : at + size] in rank:
            end = at + size
            grams.append((rank[s[at:end]], at, size))
    starts, ends = [g[1] for g in grams], [g[1] + g[2] for g in grams]
    affected = 0
    for edit in range(top - 1, len(s) - top + 1):
        affected = max(affected, bisect_right(ends, edit + top) - bisect_left(starts, edit - top + 1))
    return grams, affected


POSTED = "word string, n long, size int, bound int, bits long, grams array<struct<rank:int,at:int>>"


def _posted(words: DataFrame, rank: dict[str, int], how: Grams) -> DataFrame:
    """Of each word the grams that it is found by, its bound, and a bit for each of its grams."""
    held = words.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            sizes, bounds, bits, lists = [], [], [], []
            for word in batch.column(0).to_pylist():
                grams, bound = decomposed(word, known, how)
                table = 0
                for r, _, _ in grams:
                    table |= 1 << (r * 0x9E3779B97F4A7C15 >> 40 & 63)
                sizes.append(len(word))
                bounds.append(bound)
                bits.append(table - (1 << 64) if table >> 63 else table)
                lists.append([{"rank": r, "at": at} for r, at, _ in sorted(grams)[: bound + 1]])
            kind = pa.list_(pa.struct([("rank", pa.int32()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(bounds, pa.int32()), pa.array(bits, pa.int64()), pa.array(lists, kind)],
                ["word", "n", "size", "bound", "bits", "grams"])

    return words.select("word", "n").mapInArrow(run, POSTED)


def near_words(words: DataFrame, how: Grams, landing: Landing) -> DataFrame:
    """Pairs (u, v, n_u, n_v), each once, of words that differ by one edit."""
    posted = landing.land(_posted(words, _dictionary(words, how, landing), how))
    one = posted.select("word", "n", "size", "bound", "bits", F.explode("grams").alias("gram"))

    def key(longer: int, further: int) -> Column:
        return F.xxhash64(F.col("gram.rank"), F.col("size") + longer, F.col("gram.at") + further)

    listed = one.select(key(0, 0).alias("key"), F.col("word").alias("v"), F.col("n").alias("n_v"), F.col("bound").alias("bound_v"), F.col("bits").alias("bits_v"))
    asked = one.select(
        F.explode(F.array(key(0, 0), key(1, 0), key(1, 1))).alias("key"),
        F.col("word").alias("u"), F.col("n").alias("n_u"), F.col("bound").alias("bound_u"), F.col("bits").alias("bits_u"))
    lacking = (F.bit_count(F.col("bits_u").bitwiseAND(F.bitwise_not("bits_v"))) <= F.col("bound_u")) & (
        F.bit_count(F.col("bits_v").bitwiseAND(F.bitwise_not("bits_u"))) <= F.col("bound_v"))
    once = (F.length("u") < F.length("v")) | (F.col("u") < F.col("v"))
    near = (asked["key"] == listed["key"]) & once & lacking & (F.levenshtein("u", "v", 1) == 1)
    return asked.join(listed, near).select("u", "v", "n_u", "n_v").distinct()


def _roots(forms: DataFrame, landing: Landing) -> DataFrame:
    """(word, root) by pointer jumping: each round doubles how far a word has been followed.
    Frequencies at least double with each form, so there is no cycle and few rounds."""
    state = landing.land(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not state.filter("open").isEmpty():
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = state.join(ahead, "root", "left")
        after = landing.land(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")))
        landing.drop(state)
        state = after
    return state.select("word", "root")


def variants(words: DataFrame, ratio: int = 2, how: Grams = Grams()) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) of words (word, n): the number of near words,
    the commonest of them if it is `ratio` times as frequent at least, and the end of the forms."""
    landing = Landing(words.sparkSession, "spelling")
    words = landing.land(words.select("word", "n"))
    pairs = landing.land(near_words(words, how, landing))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("n_v").alias("n_u"), F.col("n_u").alias("n_v")))
    near = both.groupBy(F.col("u").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.first("n_u").alias("own"), F.min(F.struct((-F.col("n_v")).alias("less"), F.col("v").alias("form"))).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("own")
    near = landing.land(near.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    roots = _roots(near.filter(F.col("form").isNotNull()), landing)
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))

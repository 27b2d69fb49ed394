import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkfold.llm import hard_negatives as hn
from inkfold.llm.queries import ORACLE, is_anchor, shifted_label
from tests.compare import differences, tables

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, how=hn.Mining()):
    """All pairs, sorted."""
    usable = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        usable.append((i, [math.floor(how.scale * float(np.float32(c))) for c in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (a, va, la) in enumerate(usable):
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, label) for j, (i, v, label) in enumerate(usable) if j != k and len(v) == len(va)]
        scored.sort(key=lambda s: s[:2])
        for s, p, _ in [x for x in scored if x[2] == la][: how.positives]:
            ps = -s
            rest = [(i, -ns) for ns, i, label in scored if label != la and how.low * ps <= 100 * -ns <= how.high * ps]
            out += [(a, p, rank, i, ps, ns) for rank, (i, ns) in enumerate(rest[: how.negatives], 1)]
    return sorted(out)


def mined(spark, rows, how=hn.Mining()):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(df, is_anchor(), shifted_label(), how).collect())


def cloud(n, size=6, labels=3, seed=1):
    r = random.Random(seed)
    return [(i, [r.uniform(-0.2, 1) for _ in range(size)], r.randrange(labels)) for i in range(n)]


def test_equals_all_pairs_in_many_cells(spark):
    rows = cloud(700)
    want = plain(rows)
    assert len(want) > 200
    assert mined(spark, rows) == want
    assert mined(spark, rows, hn.Mining(anchor_block=3, row_block=90)) == plain(rows, hn.Mining(anchor_block=3, row_block=90)) == want


def test_ties_zero_and_negative_scores(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0], i % 2) for i in range(1, 260)]
    rows += [(300, [0.0, 0.0], 0), (400, [-1.0, -1.0], 1)]
    assert mined(spark, rows) == plain(rows)
    assert {r[4] for r in plain(rows) if r[0] == 300} == {0}


def test_a_hot_label_and_repeated_vectors(spark):
    rows = cloud(300, labels=2) + [(i, [0.5] * 6, 1) for i in range(300, 900)]
    assert mined(spark, rows, hn.Mining(row_block=128)) == plain(rows)


def test_what_takes_no_part(spark):
    bad = [
        (None, [1.0] * 6, 0), (1000, None, 0), (1100, [1.0] * 6, None), (1200, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0),
        (1300, [float("nan")] * 6, 0), (1400, [float("inf")] * 6, 0), (1500, [1.0, 2.0], 0), (1600, [], 1),
    ]
    rows = cloud(250) + bad
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == []


def test_repeated_ids_and_other_columns(spark):
    rows = [(i % 150, v, label) for i, v, label in cloud(300)]
    assert mined(spark, rows, hn.Mining(row_block=64)) == plain(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in cloud(220)], SCHEMA + ", anchor string, score int")
    assert sorted(map(tuple, hn.hard_negatives(df, is_anchor(), shifted_label()).collect())) == plain(cloud(220))


@pytest.mark.parametrize("top", [1e9, 1e30, 1e300])
def test_scores_too_large_for_doubles_are_exact(top):
    x = np.array([[top, 1.0, -3.0], [1.0, 2.0, 3.0]])
    got = hn.scores(x, x, 256)
    want = [[sum(math.floor(a) * 256 * math.floor(b) * 256 for a, b in zip(p, q)) for q in x.tolist()] for p in x.tolist()]
    assert got.tolist() == [[max(-(1 << 63), min((1 << 63) - 1, s)) for s in line] for line in want]


def test_the_iterator_holds_open_windows_only():
    def pairs():
        def key(score, role, other):
            fields = (7 + (1 << 63), ~(score + (1 << 63)) & (1 << 64) - 1, role, other + (1 << 63), 0)
            return hn.struct.pack(">QQBQQ", *fields)

        yield key(100, hn.POSITIVE, 1), 70
        for i in range(100_000):
            yield key(90 - i // 5000, hn.NEGATIVE, 1000 + i), 70

    found = list(hn.mined(pairs(), hn.Mining()))
    assert [(f[0], f[1], f[2], f[3]) for f in found] == [(70, 1, k + 1, 1000 + k) for k in range(10)]


def test_query_agrees_with_sql(spark):
    query = entry.queries()["op11_hard_negatives"]
    assert differences(query(spark, DATA), tables(DATA), ORACLE["op11_hard_negatives"]) == []


def test_label_may_be_any_column(spark):
    df = spark.createDataFrame([(0, [1.0], "a"), (1, [1.0], "a"), (2, [0.5], "b")], "vec_id long, embedding array<double>, kind string")
    found = hn.hard_negatives(df, F.col("id") == 0, F.col("kind")).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 2, 65536, 32768)]

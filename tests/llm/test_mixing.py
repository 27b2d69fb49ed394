import math
from collections import Counter

import pytest

from inkfold.llm import mixing as M


def table(spark, sizes, words=7):
    rows = [(s * 100_000 + i, "w " * (1 + (i * 7) % (2 * words)), f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, pass_number long")


def test_entropy_and_repetition_targets():
    tokens = [9000, 600, 300, 100]
    alpha = M.exponent(tokens, M.Mixture(entropy=1.0, repetition=None))
    w = M.weights([t / 10_000 for t in tokens], alpha)
    assert abs(M.entropy(w) - 1.0) < 1e-6 and w[0] > w[1] > w[2] > w[3]
    how = M.Mixture(repetition=3.0)
    alpha = M.exponent(tokens, how)
    times = M.passes(tokens, M.weights([t / 10_000 for t in tokens], alpha), None)
    assert max(times) == pytest.approx(3.0) and min(times) == 1.0
    assert M.exponent(tokens, M.Mixture(repetition=1e6)) == 0.0
    assert M.exponent(tokens, M.Mixture(entropy=9.0)) == 0.0 and M.exponent(tokens, M.Mixture(entropy=0.0)) == 1.0


@pytest.mark.parametrize("how", [M.Mixture(block=16), M.Mixture(repetition=4.0, block=50), M.Mixture(budget=5000, block=16)])
def test_budgets_are_met_against_a_plain_count(spark, how):
    df = table(spark, [900, 120, 60, 30])
    made = M.plan(df, how)
    size = {r.doc_id: len(r.text.split()) for r in df.collect()}
    rows = M.mix(df, how).collect()
    assert set(rows[0].asDict()) == {"doc_id", "text", "source", "pass_number"}
    for source, tokens, n, _, times in made.sources:
        taken = [r for r in rows if r.source == source]
        passes = Counter(r.pass_number for r in taken)
        whole = math.floor(times + 1e-9)
        assert all(passes[p] == n for p in range(whole)) and max(passes, default=0) <= whole
        assert all(c == 1 for c in Counter((r.doc_id, r.pass_number) for r in taken).values())
        used = sum(size[r.doc_id] for r in taken)
        assert times * tokens - 2 * max(size.values()) <= used <= times * tokens + 1
    if how.budget is None:
        assert {r.doc_id for r in rows} == set(size)  # no document is lost


def test_passes_are_permuted_anew_and_repeatably(spark):
    df = table(spark, [400, 60])
    how = M.Mixture(repetition=3.5, block=8)
    one = sorted((r.doc_id, r.pass_number) for r in M.mix(df, how).collect())
    assert one == sorted((r.doc_id, r.pass_number) for r in M.mix(df.repartition(7), how).collect())


def places_of(spark, df, how):
    out = {}
    for r in M.mix(df, how, places=True).collect():
        out.setdefault((r.source, r.pass_number), []).append((r.position, r.block, r.doc_id))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("how", [M.Mixture(repetition=3.5, block=8), M.Mixture(budget=5000, block=16)])
def test_every_pass_has_an_order_of_its_own(spark, how):
    df = table(spark, [400, 60, 30])
    got = places_of(spark, df, how)
    assert got == places_of(spark, df.repartition(7), how)
    assert sorted((d, p) for (_, p), rows in got.items() for _, _, d in rows) == sorted((r.doc_id, r.pass_number) for r in M.mix(df, how).collect())
    ids = {s: sorted(i for _, _, i in rows) for (s, p), rows in got.items() if p == 0}
    for (s, p), rows in got.items():
        assert [x for x, _, _ in rows] == list(range(len(rows)))
        assert [b for _, b, _ in rows] == sorted(b for _, b, _ in rows)  # block after block
        order = [i for _, _, i in rows]
        assert order != sorted(order) and len(set(order)) == len(order)
        for q in range(p):
            assert order != [i for _, _, i in got[s, q]][: len(order)]
            assert {i: b for _, b, i in got[s, q] if i in order} != {i: b for _, b, i in rows}
    assert any(p > 0 for _, p in got) and len(ids["s0"]) > 100


def test_ordered_rows_follow_the_passes_and_hold_the_weights_throughout(spark):
    df, how = table(spark, [900, 300]), M.Mixture(repetition=1.7, block=8)
    places = places_of(spark, df, how)
    rows = M.mix(df, how, ordered=True).collect()
    assert [(r.doc_id, r.pass_number) for r in rows] == [(r.doc_id, r.pass_number) for r in M.mix(df.repartition(7), how, ordered=True).collect()]
    for s in ("s0", "s1"):
        assert [(r.pass_number, r.doc_id) for r in rows if r.source == s] == [(p, i) for (t, p), v in sorted(places.items()) if t == s for _, _, i in v]
    share = sum(r.source == "s1" for r in rows) / len(rows)
    for part in (rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]):
        assert abs(sum(r.source == "s1" for r in part) / len(part) - share) < 0.1


def test_places_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (2, "", "a"), (3, "x y", "a"), (None, "z", None), (4, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(df, places=True, ordered=True)
    assert got.columns == ["doc_id", "text", "source", "pass_number", "block", "position"]
    assert sorted((r.source or "", r.position) for r in got.filter("pass_number = 0").collect()) == [("", 0), ("", 1), ("a", 0), ("a", 1), ("a", 2), ("empty", 0)]
    assert M.mix(df.limit(0), places=True, ordered=True).count() == 0


def test_cases(spark):
    rows = [(1, None, None), (2, "", "a"), (2, "", "a"), (3, "x y", "a"), (None, "z", None), (4, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(df).collect()
    assert {(r.doc_id, r.text, r.source) for r in got} == set(rows)
    assert sum(r.doc_id == 2 and r.pass_number == 0 for r in got) == 2
    assert M.mix(df.filter("text = ''")).count() == 3
    assert M.mix(df.limit(0)).count() == 0
    words = df.select(M.words(df.text).alias("n")).collect()
    assert sorted(r.n for r in words) == [0, 0, 0, 0, 1, 2]

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from inkfold.llm import similar_texts as S


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    """(id, size of set, smallest id reachable) of rows (id, text) by comparing all pairs."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if percent * len(sets[b]) > 100 * len(sets[a]):
                break
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def chains(seed):
    """Texts in chains of small changes, copies, common passages, short and empty ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(25):
        words = [word() for _ in range(r.randint(3, 90))] + (passage if r.random() < 0.6 else [])
        for _ in range(r.randint(1, 9)):
            out.append(r.choice([" ", "  ", "\n"]).join(words))
            if r.random() < 0.7 and words:
                words = list(words)
                words[r.randrange(len(words))] = word()
            if r.random() < 0.3:
                words = [*words, word()]
    out += ["", " ", None, "a b", "A  b", "a b c", None, "\x0ba b c\x0c"]
    r.shuffle(out)
    return [(i * 7 % 1009, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed,how", [
    (1, S.Join(words=4, percent=85)),
    (2, S.Join(block=5, fan=2, filter_bits=8)),
    (3, S.Join(words=2, percent=60, block=7, fan=3, sketch_bits=10)),
])
def test_components_are_those_of_all_pairs(spark, seed, how):
    rows = chains(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in S.similar_texts(df, how).collect())
    assert got == brute(rows, how.words, how.percent)


def test_given_documents(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    rows = list(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True))
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in S.similar_texts(df, S.Join(words=4, percent=85)).collect())
    assert got == brute(rows, 4, 85)


@pytest.mark.parametrize("same", [True, False])
def test_dual_walk_loses_no_pair(same):
    """Every pair that can be similar by its sets survives, whatever the order of the members."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, (12, 60))
    sets = [np.unique(np.where(r.random(60) < 0.04, r.integers(0, 1 << 62, 60), base[r.integers(12)])) for _ in range(150)]

    def bits(rows):
        b = np.zeros((len(rows), S.BITS), bool)
        for i, s in enumerate(rows):
            b[i, s & (S.BITS - 1)] = True
        return np.packbits(b, axis=1).view(np.uint64)

    left, right = (sets, sets) if same else (sets[:37], sets[37:])
    groups = np.arange(150)
    one = S.Tree(bits(left), np.array(list(map(len, left))), groups[: len(left)], 4)
    other = one if same else S.Tree(bits(right), np.array(list(map(len, right))), groups[37:], 4)
    a, b = S._dual_walk(one, other, same, 80)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            both = len(np.intersect1d(x, y))
            if (not same or i < j) and 100 * both >= 80 * (len(x) + len(y) - both):
                assert (i, j) in found
    assert len(found) < len(left) * len(right) / 4


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (2, None, "z"), (3, "a b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, set string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in S.similar_texts(df).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 2, 1)]
    assert S.similar_texts(df.limit(0)).count() == 0


def test_an_id_with_several_texts_unites_their_links(spark):
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (5, a + " end"), (7, b + " tail"), (9, c), (9, b + " tail"), (12, c + " x"), (20, text()), (20, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in S.similar_texts(df).collect())
    assert got == [(1, 1), (1, 1), (5, 1), (7, 1), (9, 1), (9, 1), (12, 1), (20, 20), (20, 20)]


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_texts_of_regular_structure_do_not_collide(spark):
    words = [thue_morse(2048), thue_morse(2048, True)]
    df = spark.createDataFrame([(i, f"{w} one two three four five") for i, w in enumerate(words)] + [(7, words[0]), (8, words[1])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_texts(df, S.Join(words=1, percent=90)).collect()}
    assert got == {0: 0, 1: 1, 7: 7, 8: 8}


def test_a_shingle_of_many_members(spark):
    r = random.Random(6)
    shared = "one passage that very many texts have in common and nothing more"
    rows = [(i, shared + " " + " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(r.choice([2, 2, 3, 40])))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    how = S.Join(words=2, percent=80, block=40, deal=16)
    assert sorted(tuple(r) for r in S.similar_texts(df, how).collect()) == brute(rows, 2, 80)

import random
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from inkfold.llm import spelling
from inkfold.llm.oracle import ORACLE
from tests.compare import differences, tables
from tests.helpers import plan, rows

DATA = "/root/testdata/sf0.001"


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts, ratio=2):
    forms, numbers = {}, {}
    for w, n in counts.items():
        found = [(-m, v) for v, m in counts.items() if near(w, v)]
        numbers[w] = len(found)
        if found and -min(found)[0] >= ratio * n:
            forms[w] = min(found)[1]
    out = []
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, n, numbers[w], forms.get(w), counts[forms[w]] if w in forms else None, root))
    return sorted(out, key=repr)


def words(n, seed=1, letters="abcé", least=2, most=9):
    r = random.Random(seed)
    found = {"".join(r.choice(letters) for _ in range(r.randint(least, most))) for _ in range(n)}
    for w in list(found)[: n // 2]:  # a slip each
        i = r.randrange(len(w))
        found.add(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]]))
    return {w: r.choice([1, 2, 3, 5, 8, 20, 50, 400]) for w in found if len(w) >= 2}


@pytest.mark.parametrize("how", [
    spelling.Grams(), spelling.Grams(longest=3, frequent=4), spelling.Grams(longest=4, grams=40),
    spelling.Grams(shortest=3, longest=6, frequent=1), spelling.Grams(shortest=2, longest=2),
])
def test_equals_all_pairs(spark, how):
    counts = words(700) | words(300, 2, "abcdefghijklmnopqrstuvwxyzäöüß", 5, 12)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain(counts)
    assert sum(r[2] for r in want) > 1000 and len({r[5] for r in want if r[5] != r[0]}) > 20
    assert rows(spelling.variants(df, how=how), "word", "n", "n_near", "form", "form_n", "root") == want


def test_chains_ties_and_a_hot_gram(spark):
    counts = {"abcde": 1, "abcdf": 2, "abcgf": 4, "abhgf": 8, "aihgf": 16, "jihgf": 32, "zzzzz": 3, "zzzzy": 7, "zzzzx": 7}
    counts |= {f"commonbeginning{i:03d}".translate(str.maketrans("0123456789", "qwertyuiop")): 1 + i % 7 for i in range(300)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    out = rows(spelling.variants(df), "word", "n", "n_near", "form", "form_n", "root")
    assert out == plain(counts)
    found = {r[0]: r[3:] for r in out}
    assert found["abcde"] == ("abcdf", 2, "jihgf") and found["zzzzz"] == ("zzzzx", 7, "zzzzx")


def test_the_bound_holds_for_every_edit():
    r, how = random.Random(4), spelling.Grams(longest=4, frequent=2)
    known = [w for w in words(300) if len(w) > 1]
    counts = Counter(s[i : i + q] for w in known for s in [spelling._padded(w, 4)] for q in (2, 3, 4) for i in range(len(s) - q + 1))
    rank = {g: i for i, g in enumerate(sorted((g for g in counts if len(g) == 2 or counts[g[:-1]] >= 9), key=lambda g: (counts[g], g)))}
    for w in known:
        for v in (v for v in known if near(w, v)):
            (a, lost), (b, _) = spelling.decomposed(w, rank, how), spelling.decomposed(v, rank, how)
            places = {(g, at + k) for g, at, _ in b for k in (0, len(w) - len(v))}
            assert sum((g, at) not in places for g, at, _ in a) <= lost < len(a)


def test_words_are_counted_with_their_slips(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(["Häuser", "thing", "THING", "niño×s", "abcd", "größe"]) + r.choice([".", "1x", ""]) for _ in range(40)) for _ in range(150)]
    data = [(i % 140, t, "x") for i, t in enumerate(texts)] + [(None, "thing thing", None), (7, None, ""), (8, "12 34", "")]
    want = Counter()
    for i, text, _ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 5 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    df = spark.createDataFrame(data, "doc_id long, text string, word string")
    got = rows(spelling.count_words(df, slips=5), "word", "n")
    assert got == sorted(((w, n) for w, n in want.items() if n >= 3 and len(w) >= 5), key=repr)


def test_a_task_tells_its_counts_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i, "eines anderen wortes") for i in range(50)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(spelling, "HELD_WORDS", 1)
    assert rows(spelling.count_words(df)) == [("anderen", 50), ("eines", 50), ("wortes", 50)]


def test_long_words_and_empty_tables(spark):
    counts = {"x" * 20_000: 5, "x" * 20_001: 1, "x" * 20_001 + "y": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.variants(df), "word", "n", "n_near", "form", "form_n", "root") == plain(counts)
    assert spelling.variants(df.limit(0)).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.count_words(empty)).count() == 0


def test_only_verified_pairs_leave_the_join(spark):
    df = spark.createDataFrame(list(words(100).items()), "word string, n long")
    text = plan(spelling.near_words(df, spelling.Grams(), spelling.Landing(spark, "test")))
    assert "levenshtein" in text.split("Join")[-1] and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_query_agrees_with_sql(spark):
    assert differences(entry.queries()["op13_spelling"](spark, DATA), tables(DATA), ORACLE["op13_spelling"]) == []

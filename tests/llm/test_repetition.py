import random
import re
from collections import Counter

import pyarrow.parquet as pq

from inkfold.llm import repetition as R
from inkfold.llm.words import range_hashes, split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest(words):
    """By comparing all pairs of suffixes."""
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def base(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_longest_repeats_against_all_pairs():
    r = random.Random(1)
    for _ in range(150):
        texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 5))]
        words = split_words([t.encode() for t in texts])
        hashes = range_hashes(words.buffer, words.start, words.end)
        assert R.longest_repeats(hashes, words.first).tolist() == [x for t in texts for x in longest(t.split())]
        covered, top = R.repeated(words, hashes, 3)
        for i, text in enumerate(texts):
            each = longest(text.split())
            inside = {k for j, m in enumerate(each) if m >= 3 for k in range(j, j + m)}
            assert (covered[i], top[i]) == (len(inside), max(each, default=0))


def test_base_counts(spark):
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    r = random.Random(2)
    texts += ["".join(r.choice(["a", "b#", " ", "\n", "\x0b", "\xa0", "é", "\r\n", "|"]) for _ in range(r.randint(0, 300))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for x in R.quality(df, keep=["doc_id"]).collect():
        want = base(texts[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == want
        assert not (x.base_failed and x.kept)


def test_verdict(spark):
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = fresh(120)
    texts = [
        " ".join(fresh(400)), " ".join(fresh(300) + passage + fresh(300) + passage + fresh(300)),
        " ".join(p for _ in range(2) for p in passage[:60]) + " " + " ".join(fresh(160)), "x " * 5000, " ".join(fresh(200) + passage[:12] * 2),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in R.quality(df).collect()}
    assert [got[i].kept for i in range(5)] == [True, False, False, False, True]
    assert got[1].longest_repeat == 120 and got[1].covered_words == 240 and got[3].longest_repeat == 4999


def test_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "\n\n", None)], "doc_id long, text string, kept string")
    out = R.quality(df)
    assert out.columns[:2] == ["doc_id", "text"] and out.columns.count("kept") == 1
    assert all(x.n_words == 0 and x.base_failed and not x.kept for x in out.collect())
    assert R.quality(df.limit(0)).count() == 0


def test_lines_of_regular_structure_are_compared_by_their_bytes():
    one, other = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(2048)) for k in (0, 1))
    text = "\n".join([one, other, one, "x", "x", other, ""]).encode()
    assert R.measure([text], R.Rules())["n_dup_lines"].tolist() == [3]


def test_hashes_of_ranges_tell_them_apart():
    import numpy as np

    from inkfold.llm.words import range_hashes

    data = np.frombuffer(("ab" * 5000 + "".join("ab"[bin(i).count("1") % 2] for i in range(8192))).encode(), np.uint8)
    starts = np.repeat(np.arange(0, 12000, 7), 4)
    ends = starts + np.tile([0, 3, 9, 4200], len(starts) // 4)
    found = range_hashes(data, starts, ends)
    texts = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(found.tolist())) == len(set(texts)) and len({(h, t) for h, t in zip(found.tolist(), texts)}) == len(set(texts))

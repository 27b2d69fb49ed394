import random

import public_tokenizers
from tokenizers import Tokenizer

from inkfold.llm import token_counts
from inkfold.llm.queries import BYTE_PAIRS

FILE = public_tokenizers.path(BYTE_PAIRS)
PARTS = [
    "a", "b", "the", " ", "  ", "\n", "\t", "é", "日", "😀", "'s", "'ll", "1", "²", "½", "\x85", "\xa0", "\x1c",
    "<|endoftext|>", "ß", "́", ".", "!", "ª", "Ⅷ", "ǅ", "\x00",
]


def texts():
    r = random.Random(1)
    mixed = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    return [*mixed, "a" * 1000, "ab" * 3000 + " x", "", "<|endoftext|>", "x" * 100_000]


def test_counts_are_the_librarys(spark):
    library = Tokenizer.from_file(FILE)
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, FILE, keep=["doc_id"]).collect()}
    assert got == {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows}


def test_every_proven_string_is_one_token():
    library = Tokenizer.from_file(FILE)
    whole = token_counts.whole_tokens(FILE)
    assert len(whole) > 40_000
    for text in random.Random(2).sample(whole, 3000):
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_both_merge_loops_agree():
    merges = token_counts.Merges(FILE)
    for word in ("aaaa", "thththth", "ing" * 60, "", "z"):
        assert merges._count_long(word.encode()) == merges.count(word.encode())


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a b", None), (2, "a b", None), (None, "", "")], "doc_id long, text string, n_tokens string")
    out = token_counts.count_tokens(df, FILE)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens"]
    assert sorted(r.n_tokens for r in out.collect()) == [0, 0, 2, 2]
    assert token_counts.count_tokens(df.limit(0), FILE).count() == 0

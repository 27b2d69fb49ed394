import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkfold.llm import byte_pairs
from inkfold.llm.queries import BYTE_PAIRS
from tests.helpers import plan
from tests.llm.test_token_counts import texts

FILE = public_tokenizers.path(BYTE_PAIRS)
ALL = tuple(byte_pairs.RESULTS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    digits = ",".join(map(str, ids))
    return len(ids), ids, decoded, hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("chunk_bytes", [200, byte_pairs.CHUNK_BYTES])
def test_ids_and_decoded_texts_are_the_librarys(spark, library, chunk_bytes):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in byte_pairs.encode(df, FILE, keep=["doc_id"], columns=ALL, chunk_bytes=chunk_bytes).collect()}
    assert got == {i: expected(library, t) for i, t in rows}


def test_both_merge_loops_agree(library):
    of, r = byte_pairs.vocabulary(FILE), random.Random(5)
    for size in [*range(1, 40), 300]:
        for _ in range(20):
            word = "".join(r.choice("abcdehinorst") for _ in range(size))
            ids = [of.merges.byte_ids[b] for b in word.encode()]
            assert of._merged(list(ids)) == of._merged_by_heap(list(ids)) == library.encode(word).ids


def test_a_word_of_every_chunk_and_a_long_text(spark, library):
    rows = [(i, "the " * 50 + f"word{i}") for i in range(300)] + [(1000, "the thing " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_tokens, r.ids) for r in byte_pairs.encode(df, FILE, keep=["doc_id"], columns=("n_tokens", "ids"), chunk_bytes=1000).collect()}
    assert got == {i: expected(library, t)[:2] for i, t in rows}


def test_bytes_that_are_no_utf8(spark, library):
    df = spark.createDataFrame([(1, bytearray(b"a\xff\xfeb \xe6\x97"))], "doc_id long, text binary")
    row = byte_pairs.encode(df, FILE, keep=["doc_id"], columns=("ids", "decoded")).first()
    text = b"a\xff\xfeb \xe6\x97".decode("utf-8", "replace")
    assert (row.ids, row.decoded) == (library.encode(text).ids, text)


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    rows = [(1, None, "x", 7), (2, "a b", None, 8), (2, "a b", None, 8), (None, "", "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, chunk int")
    out = byte_pairs.encode(df, FILE)
    assert out.columns == ["doc_id", "text", "chunk", "ids", "decoded"]
    assert sorted((r.chunk, len(r.ids), r.decoded) for r in out.collect()) == [(7, 0, ""), (8, 2, "a b"), (8, 2, "a b"), (9, 0, "")]
    assert byte_pairs.encode(df.limit(0), FILE).count() == 0
    assert byte_pairs.encode(df.filter("text is null"), FILE).first().decoded == ""


def test_decode_joins_ids_with_pieces(spark, library):
    r = random.Random(3)
    lists = [[r.randrange(50257) for _ in range(r.randrange(30))] for _ in range(200)] + [None, [], [50256], [10**6, 64]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(lists)], "doc_id long, ids array<int>, decoded string")
    got = {row.doc_id: row.decoded for row in byte_pairs.decode(df, FILE, keep=["doc_id", "decoded"]).collect()}
    assert got == {i: library.decode(v or [], skip_special_tokens=False) for i, v in enumerate(lists)}


def test_only_packed_words_are_shuffled(spark):
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(100)], "doc_id long, text string")
    text = plan(byte_pairs.encode(df, FILE, keep=["doc_id"]))
    assert text.count("Exchange hashpartitioning") <= 1 and "Bucketed: true" in text

import zlib

import numpy as np
import pyarrow.parquet as pq

from inkfold.llm import language
from inkfold.llm.queries import op2_language

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = dict(zip(*(pq.read_table(f"{SMALL}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "lang")), strict=True))
    got = op2_language(spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(truth) and len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_trigram_means_against_a_plain_loop():
    texts = [b"Ab, cd!", b"", "Été à b".encode(), b"x"]
    bucket, start = language.trigrams(texts)
    for i, text in enumerate(texts):
        lower = b" " + text.decode().lower().encode() + b" "
        folded = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in lower)
        windows = [folded[k : k + 3] for k in range(len(folded) - 2)]
        want = sum(w.count(b" ") <= 1 and w[1] != 0x20 for w in windows)
        assert (bucket[start[i] : start[i + 1]] < language.BUCKETS).sum() == want


def test_family_first_then_votes():
    m = language.Machine
    model = language.Model(["de", "en", "fr", "ru"], {"de": "germanic", "en": "germanic", "fr": "romance", "ru": "slavic"})
    model.machines = [m("germanic", None, 0), m("romance", None, 0), m("slavic", None, 0), m("de", "en", 0)]
    margins = np.array([[2, -1, -1, 1.0], [2, -1, -1, -1.0], [-1, 3, -1, 5.0], [-2, -1, -0.5, 5.0]])
    found, sure = language._decide(model, margins)
    assert found == ["de", "en", "fr", "ru"] and ((sure > 0) & (sure <= 1)).all()


def test_cases(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the house and the tree", "en"), ("das haus und der baum", "de")] * 30)]
    rows += [(100, None, "en", "x"), (101, "123 ²!", None, "x"), (102, "", "de", "x"), (None, "the tree", None, "x"), (0, "the house and the tree", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    from pyspark.sql import functions as F

    model = language.train(df, F.lit(True))
    out = language.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out.collect()}
    assert got[(100, None)] == got[(101, "123 ²!")] == got[(102, "")] == ("und", 0.0)
    assert got[(None, "the tree")][0] == "en" and got[(1, "das haus und der baum")][0] == "de"
    one = language.train(df.filter("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in language.predict(df.filter("doc_id < 3"), one).collect()} == {"en"}
    none = language.train(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}
    assert language.predict(df.limit(0), model).count() == 0

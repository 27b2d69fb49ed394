import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from inkfold.llm import toxicity as T
from inkfold.llm.queries import op9_toxicity

SMALL = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    labels = pq.read_table(f"{SMALL}/labels.parquet")
    truth = dict(zip(labels.column("doc_id").to_pylist(), labels.column("toxic").to_pylist(), strict=True))
    got = [r for r in op9_toxicity(spark, SMALL).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    known = [(truth[r.doc_id], r.predicted, r.score) for r in got if truth.get(r.doc_id) is not None]
    bad, good = [k for k in known if k[0]], [k for k in known if not k[0]]
    assert np.mean([k[1] for k in bad]) > 0.8 and np.mean([k[1] for k in good]) < 0.01
    ranks = np.mean([(b[2] > g[2]) + 0.5 * (b[2] == g[2]) for b in bad for g in good])
    assert ranks > 0.9


def small(spark):
    bad = ["A fine day. You are an idiotic fool! Bye.", "Nice text here\nwhat idiots they are. End."]
    good = ["A fine day. Bye.", "Nice text here.\nThey are good. End.", "Long talk about nothing. Day after day."]
    rows = [(i, (bad if i % 4 == 0 else good)[i % (2 if i % 4 == 0 else 3)], int(i % 4 == 0)) for i in range(120)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_offending_sentences_are_located(spark):
    documents, labels = small(spark)
    model = T.train(documents, labels, F.lit(True))
    text = "Été is fine. What an idiotic fool! End."
    more = spark.createDataFrame([(1, text), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.score(more, model).collect()}
    assert got[1].predicted == 1 and [text[s.start : s.end].strip() for s in got[1].toxic_sentences] == ["What an idiotic fool!"]
    assert got[2].predicted == 0 and got[2].score == got[3].score < 0.1


def test_noisy_or_against_a_plain_sum(spark):
    documents, labels = small(spark)
    model = T.train(documents, labels, F.lit(True))
    for r in T.score(documents.limit(8), model, threshold=0.0).collect():
        each = [s.score for s in r.toxic_sentences]
        rest = np.exp(-np.logaddexp(0, model.bias))
        assert np.isclose(r.score, 1 - np.prod([1 - p for p in each]) * rest)


def test_without_labels_and_empty_tables(spark):
    documents, labels = small(spark)
    nobody = T.train(documents, labels.limit(0), F.lit(True))
    assert {r.predicted for r in T.score(documents, nobody).collect()} == {0}
    one_kind = T.train(documents, labels.filter("toxic = 0").withColumn("extra", F.lit(1)), F.lit(True))
    assert len(one_kind.hashes) == 0
    null = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert len(T.train(documents, null, F.lit(True)).hashes) == 0
    out = T.score(documents.withColumn("score", F.lit("x")).limit(0), nobody)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "score", "predicted", "toxic_sentences"]

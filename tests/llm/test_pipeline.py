from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from inkfold.llm import mixing, stages
from inkfold.llm.queries import PIECES
from tests.llm.test_private_data import brute as base_spans
from tests.llm.test_similar_texts import brute as components

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage on what the one before gave, held against a plain version of its decision."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before, outputs = docs.columns, None, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        outputs.append((name, before, [r.asDict() for r in docs.collect()]))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    (_, start, clean), (_, _, single), (_, _, redacted), (_, _, mixed), (_, _, encoded) = outputs

    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 1").collect()}
    gone = {r["doc_id"] for r in start} - {r["doc_id"] for r in clean}
    assert all(r in start for r in clean) and gone
    assert len(gone - toxic) <= 0.05 * len(start) and len(toxic & gone) >= 0.5 * len(toxic)

    groups = components([(r["doc_id"], r["text"]) for r in clean], 5, 80)
    assert sorted(r["doc_id"] for r in single) == [i for i, _, c in groups if i == c]
    assert all(r in clean for r in single)

    by_id = {r["doc_id"]: r for r in single}
    changed = 0
    for r in redacted:
        old = by_id[r["doc_id"]]
        assert base_spans(r["text"]) == "" and r["n_chars"] == len(r["text"])
        assert {k: v for k, v in r.items() if k not in ("text", "n_chars")} == {k: v for k, v in old.items() if k not in ("text", "n_chars")}
        changed += r["text"] != old["text"]
        if base_spans(old["text"]):
            assert "[" in r["text"]
    assert len(redacted) == len(single) and 0 < changed < len(single) / 2

    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) == {r["doc_id"] for r in redacted} and max(copies.values()) <= 3
    assert all(r in redacted for r in mixed)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert Counter(r["doc_id"] for r in encoded) == copies
    for r in encoded:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == (library.decode(r["ids"]) if r["ids"] else "")


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    rows = [(1, "a clean text", "en", "s", 12), (1, "a clean text", "en", "s", 12), (None, None, None, None, None), (2, "", None, "s", 0), (3, "a clean text", "en", "t", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ["score", "predicted", "row", "component_id", "candidates", "pass_number", "whole", "tokens"]
    docs = docs.select("*", *[F.lit(c).alias(c) for c in clashing])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        kept = out.collect()
        assert {(r.doc_id, r.text) for r in kept} >= {(1, "a clean text"), (None, None), (2, "")}
        assert all(r[c] == c for r in kept for c in clashing)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert sorted(r.doc_id or 0 for r in stages.drop_similar(spark, docs, DATA).collect()) == [0, 1, 2]
    assert stages.encode_pieces(spark, docs, DATA).count() == len(rows)


def test_mixing_writes_the_order_of_the_mixture(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages.mix_sources(spark, docs, DATA).write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    written = [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
    assert written == [r.doc_id for r in mixing.mix(docs, ordered=True).collect()] and written != sorted(written)


def test_run_gives_every_mixed_document(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.filter(F.col("ids").isNull()).count() == 0 and out.count() >= out.select("doc_id").distinct().count() > 100

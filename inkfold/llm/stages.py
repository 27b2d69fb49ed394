"""The stages of the corpus pipeline: each takes documents and gives documents, but for the
last, which gives their tokens.

Documents are rows with doc_id, text, lang, source and n_chars.  Other columns stay, also
those with the name of a column that an operator makes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfold.llm import mixing, private_data, sentence_pieces, similar_texts, toxicity
from inkfold.llm.queries import PIECES, remainder
from inkfold.session import apply_settings
from inkfold.sources.tables import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the same four fifths
    of the ids as the query.  Null ids and texts, repeats and empty tables are scored like any
    other: a null text has the score of the bias."""
    apply_settings(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    # The other columns travel as one, so that none clashes with a result; the text goes once.
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")
    scored = toxicity.score(packed, model, keep=["row", "text"])
    whole = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return scored.filter(F.col("predicted") == 0).select(*whole)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that with the smallest id.  Rows without
    an id or a word are in no group and stay; of equal rows with one id one stays."""
    apply_settings(spark)
    found = similar_texts.similar_texts(docs)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    apply_settings(spark)
    out = private_data.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in mixture weights: every document once at least, small sources repeated up to
    twice.  Rows, and the files written of them, follow the mixture's order.  A null source is
    a source, rows with a null id count as documents, an empty table stays empty."""
    apply_settings(spark)
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = mixing.mix(packed.select("doc_id", "source", "row", mixing.words(F.col("text")).alias("n_words")), tokens=F.col("n_words"), ordered=True)
    return taken.select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to; a null or empty text has none, rows
    with a null id and repeats stay."""
    apply_settings(spark)
    model = public_tokenizers.path(PIECES)
    out = sentence_pieces.encode(docs, model, keep=["doc_id", "lang", "source"], columns=("ids", "decoded"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))

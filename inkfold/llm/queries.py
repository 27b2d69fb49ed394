"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkfold.llm import (
    byte_pairs, hard_negatives, language, main_text, mixing, near_vectors, private_data, repetition,
    sentence_pieces, similar_texts, spelling, token_counts, toxicity,
)
from inkfold.llm.oracle import ORACLE as ORACLE
from inkfold.sources.tables import table

PIECES = "piece_bpe_32k.model"
BYTE_PAIRS = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every document and decode it again."""
    documents = table(spark, folder, "documents")
    return sentence_pieces.encode_summary(documents, public_tokenizers.path(PIECES), keep=["doc_id"])


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document; learn from two thirds of the ids."""
    documents = table(spark, folder, "documents")
    held_out = remainder(3) == 1
    model = language.train(documents, ~held_out)
    found = language.predict(documents, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the documents whose sets of four-word shingles are 85 percent alike."""
    how = similar_texts.Join(words=4, percent=85)
    return similar_texts.similar_texts(table(spark, folder, "documents"), how)


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return main_text.main_texts(table(spark, folder, "pages"), keep=["page_id", "url"])


def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of the vectors with equal labels and a cosine of 0.98 or more."""
    return near_vectors.near_vectors(table(spark, folder, "embeddings"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit."""
    documents = table(spark, folder, "documents")
    counted = token_counts.count_tokens(documents, public_tokenizers.path(BYTE_PAIRS), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents the mixture takes, in how many passes over their source, and where in a pass."""
    taken = mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"), places=True)
    return taken.select("doc_id", "source", "pass_number", "block", "position")


def op8_private_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    found = private_data.find(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score every document; learn from the labels of four fifths of the ids."""
    documents = table(spark, folder, "documents")
    held_out = remainder(5) == 0
    model = toxicity.train(documents, table(spark, folder, "labels"), ~held_out)
    scored = toxicity.score(documents, model, keep=["doc_id"])
    worst = F.array_max(F.transform("toxic_sentences", lambda s: F.struct(s["score"], s["start"], s["end"])))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", "predicted",
        F.size("toxic_sentences").alias("n_toxic_sentences"), worst["start"].alias("worst_start"), worst["end"].alias("worst_end"),
    )


def op10_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    return repetition.quality(table(spark, folder, "documents"), keep=["doc_id"])


def is_anchor() -> Column:
    """Rows that negatives are mined for."""
    return F.col("id") % 100 == 0


def shifted_label() -> Column:
    """The label, moved on by one where 7 divides the id."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its first five positives."""
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"), is_anchor(), shifted_label())


def op12_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every document into byte-level pieces and decode it again."""
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    return byte_pairs.encode(table(spark, folder, "documents"), public_tokenizers.path(BYTE_PAIRS), keep=["doc_id"], columns=columns)


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, their near words, and the form and root that they vary."""
    words = spelling.count_words(table(spark, folder, "documents"), slips=97)
    return spelling.variants(words)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language": op2_language,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_main_text": op4_main_text,
    "op5_near_vectors": op5_near_vectors,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_private_data": op8_private_data,
    "op9_toxicity": op9_toxicity,
    "op10_repetition": op10_repetition,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_spelling": op13_spelling,
}

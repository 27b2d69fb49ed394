"""Documents to tokens: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm import stages
from inkfold.llm.landing import Landing
from inkfold.sources.tables import table

STAGES = [
    ("toxicity", stages.reject_toxic),
    ("jaccard_join", stages.drop_similar),
    ("private_data", stages.redact_private),
    ("mixing", stages.mix_sources),
    ("sentence_pieces", stages.encode_pieces),
]

#: SQL can't train the classifiers or encode; tests hold `run` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = Landing(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = landing.land(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

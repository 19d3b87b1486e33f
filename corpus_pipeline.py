"""From documents to token-id files: toxic documents go, one of each group of near duplicates stays, documents that hold benchmark items go,
sources are mixed to their weights, and the mix is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next one's docs. All but the last
return the columns of docs. An empty table passes through all of them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, encode, jaccard, mixing, toxicity
from tidemark.llm.common import table
from tidemark.session import written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 80 % of 5-word shingles."""
    return jaccard.keep_one(docs, n=5, percent=80)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold 80 % or more of a benchmark item's 5-word shingles."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(docs, mixing.mix(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and check sum of every document in the token-id files."""
    return encode.digest(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", contaminated), ("mixing", mixed), ("token_ids", encoded)]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

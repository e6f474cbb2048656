"""The corpus pipeline: documents in, packed token sequences out.

Every stage takes what the one before kept, written as Parquet and read again,
and returns a table; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import decontaminate, langid, neardup, packing, pii, toxicity
from paceline.llm.common import read
from paceline.llm.queries import tokenizer_path
from paceline.session import materialize, scratch


#: The key of the surrogates, for tests and checks; give a secret of your own to real runs.
SURROGATE_KEY = "a key for tests"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier scores 0.5 or more."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~langid.held_out())
    classifier = toxicity.fit(docs, labels)
    return toxicity.score(docs, classifier).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets alike to 0.8: that of the smallest doc_id."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten words of a benchmark item in a row (or a shorter item whole)."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates, n_chars following the text."""
    replaced = pii.replace_entities(docs, key=SURROGATE_KEY).drop("n_replaced")
    return replaced.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: No SQL for a learnt classifier and a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # A stage's own tables go once its result is written.
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
    return docs

"""Five corpus stages in order, each over all that the one before kept.

Every stage takes null, empty and very long texts, null ids, repeated rows, an empty table
and columns of any names: all but the last return the columns that they were given, and
what a text or id that is missing means is stated where a stage calls its operator. An
empty table stays empty. Very long texts are worked on whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievemill.llm import mixing, near_dedup, packing, pii, quality_rules
from sievemill.llm.common import fresh, shared_dir, table
from sievemill.llm.tokens import tokenizer_path


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null, empty or short text is rejected by the base
    rules; rows that repeat are judged alike."""
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "judged")
    judged = quality_rules.judged(docs, rules, docs.columns, name)
    return judged.filter(f"{name}.kept").drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one of its smallest id. Of rows that
    repeat one stays; a row without an id goes if its set equals that of another."""
    return near_dedup.unique(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. A null or empty text stays as it is; ids aren't
    looked at, rows that repeat stay alike."""
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target asks for. A null or empty
    text has no words and is in once where its source is asked for; a null source is a source
    of its own."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of a document in a training sequence. A null or empty text is the
    end id alone; rows that repeat, or have no id, have places of their own."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs

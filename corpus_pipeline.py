"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, source mixing, in this order.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame that is written as
Parquet and read again for the next one.  All but the last return the columns of documents; the last adds ``copy``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, line_dedup, near_duplicates, source_mix, toxicity
from inkwell.llm.common import ensure_checkpoints

#: Stages fit models and follow links, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.7 or more, by a model of the labelled ones.

    Null and empty texts are scored as texts without words; with no label to learn from nothing goes; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays, and n_chars, where there is such a column, follows its text.

    Null texts stay null, rows with a null key stay as they are, rows of one key are treated alike, other columns are kept."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        own = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, own).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id.

    Null and blank texts are like nothing and stay, as rows with a null key do; rows that repeat a key stay or go together."""
    return near_duplicates.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages verbatim go.

    Null texts and rows with a null key stay; with an empty benchmark all stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered from 1 in ``copy`` (or a name after it, where that is taken).

    A null source is one of its own; texts without words weigh nothing; rows of one key are taken alike; an empty table stays empty."""
    return source_mix.apply_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of documents that all stages keep, mixed."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{ensure_checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""A corpus-cleaning pipeline: toxic documents go, near-duplicates go, benchmark passages and secrets are cut out, and sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. Between stages the rows
are written as Parquet and read again.

Defined results of every stage, beside those of its operator: a null text is empty and stays null; null ids are kept; columns beyond those of `documents`
are carried along, whatever their names; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import decontaminate, mixing, secrets, simhash, toxicity
from tilewright.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.5; the network learns from the labels of the input's documents.

    Equal texts have equal scores, so copies stay or go together; repeated rows all stay. Without labels of both classes nothing goes.
    """
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word-shingle similarity 0.8 or more: the smallest id, nulls last.

    Null, empty and blank texts are one class. Of rows of one id and text the first in the order of all columns stays.
    """
    return simhash.drop_near_duplicates(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the benchmark windows that texts hold; documents covered by them beyond half go.

    Repeated rows get equal results; an empty benchmark changes nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With every secret replaced by a mark; spans that overlap or touch are one. Repeated rows get equal results."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, start and taken: how many words of each document the mix takes.

    A null source is a source of its own. Rows of equal keys stand by id and size.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The stages before the mix can't be put in SQL; they are tested against brute force.
ORACLE_SQL = None


def _written(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """All stages but the last over `documents`: each is written below `folder`, and the one before it is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            old = paths.Path(before)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        before = f"{folder}/{name}"
    return docs


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over `documents`: the plan of the mix. The cleaned documents stay in the last stage's folder below `folder`."""
    return mix_sources(spark, _written(spark, sf_dir, folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"), sf_dir)


def write_corpus(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes `<folder>/corpus`: doc_id, source, epoch and text of what the mix takes of the cleaned documents."""
    mixing.mixed_texts(_written(spark, sf_dir, folder)).write.parquet(f"{folder}/corpus")

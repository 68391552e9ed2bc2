"""From raw documents to packed windows: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapweave.llm.decontaminate import without_contaminated
from snapweave.llm.line_dedup import loaded
from snapweave.llm.near_dedup import without_near_duplicates
from snapweave.llm.packing import PackingConfig, pack
from snapweave.llm.queries import tokenizer_path
from snapweave.llm.toxicity import without_toxic
from snapweave.session import ship_package
from snapweave.storage import Scratch, released


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first that holds them."""
    return loaded(docs).rewrite(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens with the sources' shares of the corpus."""
    return pack(docs, PackingConfig(tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The learned, hashed and aligned stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again.

    What a stage leaves in the shared folder besides its result goes as soon as that is written, and the result
    as soon as the next one's is.
    """
    ship_package(spark)
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with released(spark, scratch):
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

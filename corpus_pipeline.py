"""A training-corpus pipeline of five stages, each over all rows that the one before it kept.

quality rules -> line dedup -> SimHash near-dedup -> benchmark decontamination -> mixing to target weights
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.llm.common import finished
from eventflow.llm.decontaminate import decontaminate
from eventflow.llm.line_dedup import line_dedup
from eventflow.llm.mixing import mixed_corpus
from eventflow.llm.quality import quality_filter
from eventflow.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_filter(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to many documents stay in one of them; ``n_chars`` follows the text."""
    out = line_dedup(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 or more of their five-word shingles in common) stays."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a row per document and epoch, with ``epoch`` and ``words_taken``."""
    return mixed_corpus(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_common_lines),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", mix_to_weights),
]

#: The stages aren't all SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix; tables between stages last until it is written."""

    def stages() -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        *before, (_, last) = STAGES
        for name, stage in before:
            docs = finished(spark, f"stage-{name}", partial(stage, spark, docs, sf_dir))
        return last(spark, docs, sf_dir)

    return finished(spark, "pipeline", stages)

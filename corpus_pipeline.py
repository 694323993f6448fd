"""A cleaning pipeline over ``documents`` of five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, nearcopies, rules, sampling, toxicity
from larkspur.llm.common import fresh, scratch, table
from larkspur.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model fitted on the labels of a sample. Without labels all stay.

    Null and empty texts stay, as the model's bias is far below 0.5 where most labels are 0; repeated rows fare alike.
    """
    model, (out,) = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True)), fresh(docs, "toxic")
    return toxicity.score(docs, model, out=out).filter(F.col(out) < 0.5).drop(out)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the weighed votes of the quality rules keep; null and empty texts go."""
    return rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least key, of those that links of 0.8 of the five-word shingles join.

    Candidates come from op5's fingerprints and trees, and each link is verified. Texts without words are equal, null ones too.
    """
    return nearcopies.near_dedup(docs, words=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote no benchmark item; null and empty texts quote none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with their scores; decodes says that they give the text back."""
    return sampling.segmentations(docs, vocabulary_path("piece_bpe_32k.model"), k=2)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("near copies", drop_near_copies), ("benchmark", drop_benchmark), ("segmentations", segment)]

#: No SQL states a fitted model, near copies or sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of ``documents``; an empty table gives an empty one. Each stage's table is in the shared folder until the application ends."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

"""Corpus pipeline: documents pass the stages of STAGES in order; each stage's rows are written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noisefleet.llm import golay_simhash, line_dedup, merge_dropout, mixing, quality_trees
from noisefleet.llm.common import stored, table
from noisefleet.llm.registry import MODEL

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_trees.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the blocks of lines that an earlier one has; what was a copy is left empty."""
    return line_dedup.dedup_lines(docs).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; the emptied ones are a group too."""
    return golay_simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per pass of the mix over a document, in training order."""
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    return merge_dropout.encode(docs, merge_dropout.read_model(MODEL))


STAGES: list[tuple[str, Stage]] = [
    ("quality_trees", keep_good),
    ("line_dedup", dedup_lines),
    ("golay_simhash", drop_near_copies),
    ("mix_sources", mix_sources),
    ("merge_dropout", encode),
]

# Trees, alignments, fingerprints and segmentations have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

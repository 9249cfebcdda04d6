"""Helpers of the training-data operators: word counts and stored intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefleet.session import new_folder

# Fixed value: a word is what ASCII white space parts.
WORD = r"[^\x20\x09-\x0D]+"
# Rows and bytes that go to Python at a time where rows are whole texts.
TEXT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from there; outlives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands its rows to Python in small batches: a task holds them in the JVM and in Python. The session's options come back."""
    before = {name: spark.conf.get(name, None) for name in TEXT_BATCH}
    try:
        for name, value in TEXT_BATCH.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Helpers shared by the query registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 4, skip: Sequence[str] = ()) -> DataFrame:
    """Round the double columns, so results compare across engines that sum in another order."""
    return dates_as_text(df.select([F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
                                    for c, t in df.dtypes]))


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])

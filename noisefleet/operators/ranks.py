"""Exact order statistics from counted values.

Readings are first reduced to ``(keys, value, n)`` with a map-side partial count, so copies of one
level collapse before the shuffle and a hot site spreads over its distinct levels. Ranks come from
prefix sums in three steps: over the level bins of a key (a bounded number), over the cells of a bin
(``FINE_BINS`` at most) and inside a cell, a four-thousandth of a decibel wide. So levels that are not
rounded spread too, and nothing holds a whole site. Interpolation is linear between neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.session import cut_lineage

BIN_WIDTH = 0.25
MAX_BIN = 4096
FINE_BINS = 1024


def value_counts(df: DataFrame, keys: Sequence[str], value: str = "leq") -> DataFrame:
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")))


def kept_counts(df: DataFrame, keys: Sequence[str], value: str = "leq") -> DataFrame:
    """:func:`value_counts`, written once, for callers that go through them several times.

    Levels come in steps of the meter's resolution, so the counts are far smaller than the readings.
    """
    return cut_lineage(value_counts(df, keys, value))


def ranked(counts: DataFrame, keys: Sequence[str], bin_width: float = BIN_WIDTH) -> DataFrame:
    """Add to every distinct value its 0-based rank range ``[rank0, rank1)`` and the group size."""
    at = F.col("v") / F.lit(bin_width)
    coarse = F.greatest(F.lit(-MAX_BIN), F.least(F.lit(MAX_BIN), F.floor(at)))
    fine = F.greatest(F.lit(0), F.least(F.lit(FINE_BINS - 1), F.floor((at - coarse) * FINE_BINS)))
    b = counts.withColumn("_bin", coarse.cast("int")).withColumn("_fine", fine.cast("int"))
    cells = b.groupBy(*keys, "_bin", "_fine").agg(F.sum("n").alias("_fn"))
    per_key, per_bin = Window.partitionBy(*keys), Window.partitionBy(*keys, "_bin")
    bins = cells.groupBy(*keys, "_bin").agg(F.sum("_fn").alias("_bn")).select(
        *keys, "_bin",
        (F.sum("_bn").over(per_key.orderBy("_bin")) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(per_key).alias("n_total"))
    cells = cells.select(*keys, "_bin", "_fine", (F.sum("_fn").over(per_bin.orderBy("_fine")) - F.col("_fn")).alias("_above")).join(
        bins, [*keys, "_bin"])
    inside = Window.partitionBy(*keys, "_bin", "_fine").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return (b.join(cells, [*keys, "_bin", "_fine"])
            .withColumn("rank1", F.col("_before") + F.col("_above") + F.sum("n").over(inside))
            .withColumn("rank0", F.col("rank1") - F.col("n"))
            .drop("_before", "_above", "_bin", "_fine"))


def value_at(rank: Column) -> Column:
    """Aggregate over :func:`ranked` rows: the value holding a 0-based rank."""
    return F.max(F.when((F.col("rank0") <= rank) & (rank < F.col("rank1")), F.col("v")))


def percentile_of_ranked(p: float) -> Column:
    """Aggregate over :func:`ranked` rows: linearly interpolated percentile, ``0 <= p <= 1``."""
    pos = F.lit(float(p)) * (F.col("n_total") - 1)
    lo, hi = value_at(F.floor(pos)), value_at(F.ceil(pos))
    frac = F.max(pos - F.floor(pos))
    return lo + (hi - lo) * frac


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with an exact percentile per entry of ``probs``."""
    r = ranked(value_counts(df, keys, value), keys)
    return r.groupBy(*keys).agg(*[percentile_of_ranked(p).alias(n) for n, p in probs.items()])

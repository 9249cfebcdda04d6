"""Peaks whose prominence reaches the standard deviation of the record.

A peak of height p counts if, on each side, a reading at or below p - sd comes before any reading
above p. Walking away from the peak, that is decided by two numbers about the readings passed: their
minimum, and a value A that every reading x moves to the nearest point of [x, x + sd]; the side is
fine when p >= A and p >= minimum + sd. Such moves compose: a whole slice of the record maps A to the
nearest point of one interval. So slices are reduced by themselves, their summaries are folded along
each site (one row per 262,144 readings), and each slice is read once more with what came before and
after it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noisefleet.operators import aggregates as agg
from noisefleet.operators.scans import ROWS_PER_SLICE, SITE, row_slice, top_rows
from noisefleet.session import cut_lineage

_SUMMARY = ("lo", "hi", "back_lo", "back_hi", "least", "first", "final", "turn")
_CARRY = ("sd", "left_a", "left_min", "right_a", "right_min", "before", "after")


def moves(x: np.ndarray, sd: float) -> tuple[np.ndarray, np.ndarray]:
    """Interval that the first i+1 readings map A into, for every i (a prefix scan by doubling)."""
    lo, hi, step = x.copy(), x + sd, 1
    while step < len(x):
        nlo, nhi = np.clip(lo[:-step], lo[step:], hi[step:]), np.clip(hi[:-step], lo[step:], hi[step:])
        lo[step:], hi[step:] = nlo, nhi
        step *= 2
    return lo, hi


def _summarise(keys: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x, sd = pdf["level"].to_numpy(float), float(pdf["sd"].iloc[0])
        lo, hi = moves(x, sd)
        back_lo, back_hi = moves(x[::-1], sd)
        other = x[x != x[0]]
        row = {k: pdf[k].iloc[0] for k in (*keys, "_slice")}
        row |= dict(zip(_SUMMARY, (lo[-1], hi[-1], back_lo[-1], back_hi[-1], x.min(), x[0], x[-1],
                                   other[0] if len(other) else np.nan)))
        return pd.DataFrame([row | {"sd": sd}])
    return one


def _carry(keys: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice").reset_index(drop=True)
        n, out = len(pdf), pdf[[*keys, "_slice", "sd"]].copy()
        left_a, left_min, before = np.full(n, -np.inf), np.full(n, np.inf), np.full(n, np.nan)
        right_a, right_min, after = np.full(n, -np.inf), np.full(n, np.inf), np.full(n, np.nan)
        c = {name: pdf[name].to_numpy(float) for name in _SUMMARY}
        for i in range(1, n):
            left_a[i] = np.clip(left_a[i - 1], c["lo"][i - 1], c["hi"][i - 1])
            left_min[i] = min(left_min[i - 1], c["least"][i - 1])
            before[i] = c["final"][i - 1]
        for i in range(n - 2, -1, -1):
            right_a[i] = np.clip(right_a[i + 1], c["back_lo"][i + 1], c["back_hi"][i + 1])
            right_min[i] = min(right_min[i + 1], c["least"][i + 1])
            # first value after the slice that differs from its last one
            v = c["final"][i]
            if c["first"][i + 1] != v:
                after[i] = c["first"][i + 1]
            else:
                after[i] = c["turn"][i + 1] if not np.isnan(c["turn"][i + 1]) else after[i + 1]
        for name, values in zip(_CARRY[1:], (left_a, left_min, right_a, right_min, before, after)):
            out[name] = values
        return out
    return one


def _peaks(keys: Sequence[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def one(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "seq", "level"]
        if pdf.empty or carry.empty:
            return pdf[names].iloc[:0]
        pdf, c = pdf.sort_values("seq"), carry.iloc[0]
        x, sd, n = pdf["level"].to_numpy(float), float(c["sd"]), len(pdf)

        def side(v: np.ndarray, a0: float, m0: float) -> np.ndarray:
            """Whether the readings before each position of ``v`` (and those carried in) let it stand."""
            lo, hi = moves(v, sd)
            a = np.concatenate(([a0], np.clip(a0, lo, hi)[:-1]))
            m = np.concatenate(([m0], np.minimum(m0, np.minimum.accumulate(v))[:-1]))
            return (v >= a) & (v >= m + sd)

        stands = side(x, c["left_a"], c["left_min"]) & side(x[::-1], c["right_a"], c["right_min"])[::-1]
        rise = np.diff(x, prepend=c["before"])
        # the next value that differs: found at the next change, or carried in from the following slices
        change = np.flatnonzero(np.append(x[1:] != x[:-1], True))
        nxt = np.append(x, c["after"])[change[np.searchsorted(change, np.arange(n))] + 1]
        return pdf.loc[(rise > 0) & (nxt < x) & stands, names]
    return one


def prominent_peaks(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq",
                    rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One row per peak (a flat top counts once, at its first reading), in recorded order."""
    x = df.where(F.col(level).isNotNull()).select(*keys, "seq", F.col(level).cast("double").alias("level"))
    spread = x.groupBy(*keys).agg(F.stddev_samp("level").alias("sd")).where(F.col("sd") > 0)
    rows = x.join(spread, list(keys)).withColumn("_slice", row_slice("seq", rows_per_slice))
    part = [*keys, "_slice"]
    kept = [f for f in rows.schema if f.name in part]
    doubles = T.DoubleType()
    summary = rows.groupBy(*part).applyInPandas(
        _summarise(keys), T.StructType([*kept, *[T.StructField(c, doubles) for c in (*_SUMMARY, "sd")]]))
    carry = summary.groupBy(*keys).applyInPandas(
        _carry(keys), T.StructType([*kept, *[T.StructField(c, doubles) for c in _CARRY]]))
    points = T.StructType([f for f in rows.schema if f.name in (*keys, "seq", "level")])
    return rows.drop("sd").groupBy(*part).cogroup(carry.groupBy(*part)).applyInPandas(_peaks(keys), points)


def peak_summary(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq",
                 rows_per_slice: int = ROWS_PER_SLICE, listed_n: int = 5) -> DataFrame:
    """Number of peaks, the ``listed_n`` highest and last ones, the rate, and the energy average of the top decile."""
    peaks = cut_lineage(prominent_peaks(df, keys, level, rows_per_slice))
    slice_ = row_slice("seq", rows_per_slice)

    def listed(order: list, name: str, by: str, reverse: bool) -> DataFrame:
        few = top_rows(peaks, keys, slice_, order, listed_n)
        vals = F.transform(F.sort_array(F.collect_list(F.struct(F.col(by).alias("o"), F.col("level").alias("v"))), not reverse),
                           lambda s: s["v"])
        return few.groupBy(*keys).agg(vals.alias(name))

    n = df.where(F.col(level).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counted = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("number_of_peaks"))
    top = listed([F.desc("level"), F.asc("seq")], "top5_by_level", "level", True)
    last = listed([F.desc("seq")], "last5_in_time", "seq", False)
    found = F.coalesce("number_of_peaks", F.lit(0))
    none = F.array().cast("array<double>")
    k = list(keys)
    return (n.join(counted, k, "left").join(top, k, "left").join(last, k, "left")
            .join(agg.top_decile_laeq(df, keys, level), k, "left")
            .select(*keys, found.alias("number_of_peaks"), F.coalesce("top5_by_level", none).alias("top5_by_level"),
                    F.coalesce("last5_in_time", none).alias("last5_in_time"),
                    (found / F.col("n") * 1000.0).alias("peaks_per_1000"), "top_decile_laeq", F.col("max_level").alias("max_peak")))

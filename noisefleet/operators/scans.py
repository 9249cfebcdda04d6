"""Ordered computations (lag, lead, running sum, last known value) that split a long site.

A window partitioned by site alone puts the whole site in one task. Here every site is cut into
slices of its order (an hour of time, or a range of row numbers). Each slice is scanned by itself,
leaves a one-row summary, the summaries are scanned per site, and the result is joined back as the
value carried into the slice. The only per-site window runs over slices, not readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITE = ("site_id",)
ROWS_PER_SLICE = 1 << 18
_SLICE = "_slice"


def hour_slice(ts: Column | str) -> Column:
    """Slice by clock hour: 3,600 readings at 1 Hz."""
    return F.date_trunc("HOUR", F.col(ts) if isinstance(ts, str) else ts)


def row_slice(seq: Column | str, rows: int = ROWS_PER_SLICE) -> Column:
    """Slice by recorded position; ``seq`` is unique within a site."""
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(c / F.lit(rows)).cast("long")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column | None,
    order: Sequence[str],
    *,
    keep_slice: bool = False,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    befores: dict[str, Column] | None = None,
) -> DataFrame:
    """Add previous/next values, running sums and last non-null values.

    ``lasts`` include the row itself, ``befores`` do not.

    ``order`` must be a total order within the keys. ``slice_by`` must not decrease along it. A scan
    with ``keep_slice`` leaves the slice on its rows; a following scan given ``slice_by=None`` reuses
    it, and with it the partitioning.
    """
    lags, leads, sums, lasts, befores = lags or {}, leads or {}, sums or {}, lasts or {}, befores or {}
    at = F.struct(*[F.col(c) for c in order])
    sliced = df if slice_by is None else df.withColumn(_SLICE, slice_by)
    part = [*keys, _SLICE]
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local = {}
    if lags:
        local["_first"] = F.row_number().over(w) == 1
    if leads:
        local["_final"] = F.lead(F.lit(1)).over(w).isNull()
    local |= {f"_l_{n}": F.lag(c).over(w) for n, c in lags.items()}
    local |= {f"_l_{n}": F.lead(c).over(w) for n, c in leads.items()}
    local |= {f"_l_{n}": F.sum(c).over(upto) for n, c in sums.items()}
    local |= {f"_l_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
    local |= {f"_l_{n}": F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for n, c in befores.items()}
    lasts = lasts | befores

    summary = sliced.groupBy(*part).agg(
        *[F.max_by(F.struct(c.alias("v")), at).alias(f"_s_{n}") for n, c in lags.items()],
        *[F.min_by(F.struct(c.alias("v")), at).alias(f"_s_{n}") for n, c in leads.items()],
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_s_{n}") for n, c in lasts.items()],
    )
    across = Window.partitionBy(*keys).orderBy(_SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *part,
        *[F.lag(f"_s_{n}").over(across).getField("v").alias(f"_c_{n}") for n in lags],
        *[F.lead(f"_s_{n}").over(across).getField("v").alias(f"_c_{n}") for n in leads],
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    )
    joined = sliced.withColumns(local).join(carry, part, "left")
    result = {n: F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")) for n in lags}
    result |= {n: F.when(F.col("_final"), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")) for n in leads}
    result |= {n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_c_{n}") for n in sums}
    result |= {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in lasts}
    carried = [c for c in sliced.columns if keep_slice or c != _SLICE]
    return joined.select(*carried, *[c.alias(n) for n, c in result.items()])


def pairs(df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str]) -> DataFrame:
    """Every reading with the one before it, as structs ``prev`` (NULL for the first) and ``cur``.

    Pairs inside a slice come from a window; pairs across slices from the slices' first and last rows.
    Nothing is joined back, so a filter on the pairs applies at once.
    """
    part = [*keys, _SLICE]
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    sliced = df.withColumn(_SLICE, slice_by).withColumn("_row", row)
    at = F.struct(*[F.col(c) for c in order])
    inside = sliced.select(*keys, F.lag("_row").over(Window.partitionBy(*part).orderBy(*order)).alias("prev"),
                           F.col("_row").alias("cur"))
    ends = sliced.groupBy(*part).agg(F.min_by("_row", at).alias("cur"), F.max_by("_row", at).alias("_last"))
    across = ends.select(*keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy(_SLICE)).alias("prev"), "cur")
    return inside.where(F.col("prev").isNotNull()).unionByName(across)


def islands(df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], starts: Column,
            name: str = "island") -> DataFrame:
    """Number consecutive runs: ``starts`` is true on the first row of each run."""
    return scan(df, keys, slice_by, order, sums={name: F.when(starts, 1).otherwise(0)})


def top_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key in ``order``: cut to ``k`` inside every bucket, then across buckets."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    cut = df.withColumn("_bucket", bucket).withColumn("_k", F.row_number().over(inside)).where(F.col("_k") <= k)
    ranked = cut.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= k).drop("_bucket", "_k")

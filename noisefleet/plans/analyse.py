"""The analysis of a fleet: filters in their order, then every result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.operators import aggregates as agg
from noisefleet.operators import clocks, compare, continuity, filters
from noisefleet.operators import periods as per
from noisefleet.operators.scans import SITE
from noisefleet.plans.screen import Screen


def filter_record(readings: DataFrame, *, source: str = ck.DEFAULT_ZONE, target: str = ck.DEFAULT_ZONE, start: str | None = None,
                  end: str | None = None, exclusions: DataFrame | None = None, keys: Sequence[str] = SITE) -> DataFrame:
    """Clock conversion, then date bounds, then exclusion windows. A weather screen comes after these."""
    df = filters.between(clocks.convert_clock(readings, source, target), start, end)
    return df if exclusions is None else filters.drop_excluded(df, exclusions, keys)


def screened_exclusions(screen: Screen, exclusions: DataFrame | None = None, keys: Sequence[str] = SITE) -> DataFrame:
    """Windows that count as excluded, not missing: the analyst's and the runs the screen removed."""
    removed = filters.removed_windows(screen.readings.withColumn("kept", F.col("reason").isNull()), keys).select(*keys, "start", "end")
    return removed if exclusions is None else removed.unionByName(exclusions.select(*keys, "start", "end"))


def about(readings: DataFrame, zone: str, environment: str = "outdoor", keys: Sequence[str] = SITE) -> DataFrame:
    """What a result set describes, as (item, value) rows per site."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    span = readings.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    items = {"Time basis": ck.time_basis(zone, F.col("a"), F.col("b")), "Record start": F.coalesce(F.date_format("a", stamp), F.lit("")),
             "Record end": F.coalesce(F.date_format("b", stamp), F.lit("")), "Readings analysed": F.col("n").cast("string"),
             "Level channel for period metrics": F.lit("leq"), "Microphone placement": F.lit(environment)}
    rows = F.array(*[F.struct(F.lit(i).alias("row"), F.lit(k).alias("item"), c.alias("value")) for i, (k, c) in enumerate(items.items(), 1)])
    return span.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def result_tables(readings: DataFrame, *, zone: str = ck.DEFAULT_ZONE, exclusions: DataFrame | None = None, environment: str = "outdoor",
                  integrity: DataFrame | None = None, keys: Sequence[str] = SITE) -> dict[str, DataFrame]:
    """Every result table of an analysis, lazily. Persist ``readings`` if several are written."""
    interval = continuity.modal_interval(readings, keys)
    levels = compare.limit_inputs(readings, keys)
    if integrity is not None:
        levels = compare.suppress_untrusted(levels, integrity, keys)
    env: Column = F.lit(environment)
    stats = agg.channel_stats(readings, keys)
    return {
        "about": about(readings, zone, environment, keys),
        "period_levels": per.period_levels(levels, keys),
        "statistics": agg.distribution_label(stats),
        "exceedance": agg.exceedance(readings, keys),
        "data_quality": agg.data_quality(readings, keys),
        "daily": per.daily_summary(readings, interval, zone, keys),
        "hourly": per.hourly_summary(readings, keys),
        "guideline_comparison": compare.compliance_matrix(levels, env, keys),
        "minute_levels": per.minute_levels(clocks.ordering_key(readings, keys), keys),
        "gaps": continuity.gaps(readings, zone, exclusions, keys),
        "gap_summary": continuity.gap_summary(readings, zone, exclusions, keys),
        "key_findings": agg.key_findings(readings, keys),
        "periods_over_limit": per.periods_over_limit(readings, interval, zone, keys),
    }

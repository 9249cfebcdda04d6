"""Result tables in their export schema, and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.functions import levels as lv
from noisefleet.operators.periods import COMPLETE_COVERAGE_PCT
from noisefleet.operators.scans import SITE


def _r(c: str, digits: int) -> Column:
    """Half-even on the scaled binary value, as array libraries round."""
    scale = F.lit(float(10 ** digits))
    return F.rint(F.col(c) * scale) / scale


def daily_export(daily: DataFrame, basis: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Daily summary with the published column names and decimals."""
    return daily.join(basis.select(*keys, "time_basis"), list(keys)).select(
        *keys, F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("time_basis").alias("Time_basis"),
        _r("hours_measured", 3).alias("Hours_measured"), _r("day_coverage_pct", 2).alias("Day_coverage_pct"),
        F.when(F.col("day_coverage_pct") < COMPLETE_COVERAGE_PCT, "yes").otherwise("no").alias("Partial_day"),
        _r("laeq", 2).alias("LAeq_00_24_dBA"), _r("min_leq", 2).alias("Min_LEQ_dBA"), _r("max_leq", 2).alias("Max_LEQ_dBA"),
        _r("std_dev", 2).alias("SD_LEQ_dB"), _r("day_laeq", 2).alias("LAeq_07_22_dBA"),
        _r("night_laeq", 2).alias("LAeq_night_22_07_from_this_date_dBA"), _r("night_coverage_pct", 2).alias("Night_coverage_pct"),
        _r("lden", 2).alias("Lden_07_to_07_from_this_date_dBA"), _r("lden_coverage_pct", 2).alias("Lden_period_coverage_pct"))


def hourly_export(hourly: DataFrame, basis: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    return hourly.join(basis.select(*keys, "time_basis"), list(keys)).select(
        *keys, F.format_string("%02d:00", "hour").alias("Hour_start"), F.col("time_basis").alias("Time_basis"),
        _r("laeq", 2).alias("LAeq_dBA"), _r("min_leq", 2).alias("Min_LEQ_dBA"), _r("max_leq", 2).alias("Max_LEQ_dBA"),
        _r("std_dev", 2).alias("SD_LEQ_dB"))


def weather_audit(blocks: DataFrame, zone: str, clock: str, keys: Sequence[str] = SITE) -> DataFrame:
    """One row per weather block, as a reviewer reads it."""
    minute = "yyyy-MM-dd HH:mm"
    return blocks.select(
        *keys, F.date_format(ck.utc_to_logger("block_start_utc", zone, clock), minute).alias("block_start_logger_clock"),
        F.date_format("block_start_utc", minute).alias("block_start_utc"), F.coalesce("reason", F.lit("clean")).alias("status"),
        F.col("verified").alias("weather_verified"), F.col("precip").alias("precipitation"), "rain", "snow",
        F.col("other").alias("other_precip"), "thunder", _r("wind_mic_ms", 2).alias("estimated_mean_wind_at_mic_m_s"),
        _r("wind_station_max_ms", 2).alias("maximum_station_wind_or_gust_m_s"),
        F.col("n_1min").alias("minutes_1min_obs"), F.col("n_metar").alias("minutes_metar_obs"))


def finite_doubles(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL in every double column."""
    return df.select([lv.finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_readings(df: DataFrame, path: str, keys: Sequence[str] = SITE, mode: str = "overwrite") -> None:
    """The merged record as Parquet partitioned by site; overwriting replaces the sites of ``df`` and no others.

    Rows are spread by site and hour before the write, so a hot site is written by many tasks; the
    files of one site stay together in its folder.
    """
    spread = df.withColumn("_day", F.to_date("ts")).repartition(*keys, "_day").drop("_day")
    finite_doubles(spread).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each result table to its own Parquet folder."""
    for name, df in tables.items():
        finite_doubles(df).write.mode(mode).parquet(f"{path}/{name}")

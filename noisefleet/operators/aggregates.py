"""Level aggregations per site.

Two plan shapes cover all of them: one conditional aggregate over the readings (map-side partials),
or counted levels from :mod:`ranks` when order statistics or moments are needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.functions import levels as lv
from noisefleet.operators import ranks
from noisefleet.operators.scans import SITE, row_slice

CHANNELS = ("leq", "lmax", "lmin")
# Shares and thresholds of the descriptive rules.
DOMINATED_TOP1_PCT, DOMINATED_OVER_L5_DB = 10.0, 1.0
OUTLIER_IQR = 1.5
SKEW_LIMIT, KURTOSIS_LIMIT = 0.5, 3.0
TREND_SLOPE, TREND_MODERATE, TREND_STRONG = 0.001, 0.4, 0.7
SLEEP_LAMAX_DB = 60.0
FINDINGS_DB = 53.0


def by_channel(df: DataFrame, keep: Sequence[str] = SITE, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """One row per reading and level channel."""
    return df.unpivot(list(keep), list(channels), "channel", "level")


def site_laeq(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq") -> DataFrame:
    return df.groupBy(*keys).agg(lv.laeq(level).alias("laeq"), F.count(level).alias("n"))


def exceedance(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq") -> DataFrame:
    """L5, L10, L50, L90, L95: exact, interpolated."""
    return ranks.percentiles(df, keys, level, lv.EXCEEDANCE)


def energy_concentration(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq", least_n: int = 20) -> DataFrame:
    """How much of the energy sits in the loudest reading and the loudest 0.1 %; NULL under ``least_n`` readings."""
    r = ranks.ranked(ranks.value_counts(df, keys, level), keys)
    n = F.col("n_total")
    top = F.greatest(F.lit(1), F.bround(n * 0.001).cast("long"))
    # readings of this level that fall among the loudest `top`
    in_top = F.greatest(F.lit(0), F.col("rank1") - F.greatest(F.col("rank0"), n - top))
    e = lv.energy("v")
    g = r.groupBy(*keys).agg(
        F.max("n_total").alias("n"),
        F.max(top).alias("n_top01pct"),
        F.sum(e * F.col("n")).alias("_total"),
        F.max(e).alias("_top1"),
        F.sum(e * in_top).alias("_top01"),
        F.sum(F.when(in_top == 0, e * F.col("n"))).alias("_rest"),
        F.sum(F.when(in_top == 0, F.col("n"))).alias("_n_rest"),
        ranks.percentile_of_ranked(0.95).alias("l5"),
    )
    la = lv.to_db(F.col("_total") / F.col("n"))
    top1 = 100.0 * F.col("_top1") / F.col("_total")
    told = {"laeq": la, "l5": F.col("l5"), "laeq_minus_l5": la - F.col("l5"), "top1_energy_pct": top1,
            "top01pct_energy_pct": 100.0 * F.col("_top01") / F.col("_total"), "n_top01pct": F.col("n_top01pct"),
            "laeq_excluding_top01pct": lv.to_db(F.col("_rest") / F.col("_n_rest")),
            "dominated": (top1 >= DOMINATED_TOP1_PCT) | (la - F.col("l5") > DOMINATED_OVER_L5_DB)}
    return g.select(*keys, "n", *[F.when(F.col("n") >= least_n, c).alias(name) for name, c in told.items()])


def rating_columns(hour: Column, level: Column | str = "leq", ldn_windows=(lv.DAY_LDN, lv.NIGHT_LDN),
                   lden_windows=(lv.DAY_LDEN, lv.EVENING_LDEN, lv.NIGHT_LDEN)) -> dict[str, Column]:
    """Window LAeq aggregates that Ldn and Lden are computed from."""
    window = {"laeq_day_ldn": ldn_windows[0], "laeq_night_ldn": ldn_windows[1],
              "laeq_day_lden": lden_windows[0], "laeq_evening_lden": lden_windows[1],
              "laeq_night_lden": lden_windows[2]}
    return {"laeq_24h": lv.laeq(level), **{
        n: lv.laeq(level, F.lit(False) if h is None else lv.in_hours(hour, h)) for n, h in window.items()}}


def rating_levels(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq", **windows) -> DataFrame:
    """LAeq by period, Ldn, Lden and Lnight in one pass; a missing period makes its rating NULL.

    Periods are weighted by their hours, not by how many readings they hold.
    """
    timed = df.where(F.col("ts").isNotNull() & F.col(level).isNotNull())
    g = timed.groupBy(*keys).agg(
        *[c.alias(n) for n, c in rating_columns(F.hour("ts"), level, **windows).items()])
    return g.select(
        "*", F.col("laeq_night_lden").alias("lnight"),
        lv.ldn(F.col("laeq_day_ldn"), F.col("laeq_night_ldn")).alias("ldn"),
        lv.lden(F.col("laeq_day_lden"), F.col("laeq_evening_lden"), F.col("laeq_night_lden")).alias("lden"))


def share_at_or_above(df: DataFrame, threshold: float, keys: Sequence[str] = SITE, level: str = "leq") -> DataFrame:
    return df.groupBy(*keys).agg(lv.pct_at_or_above(level, threshold).alias("pct"))


def share_in_window(df: DataFrame, threshold: float, window: tuple[int, int], keys: Sequence[str] = SITE,
                    level: str = "leq") -> DataFrame:
    timed = df.where(F.col("ts").isNotNull())
    inside = lv.in_hours(F.hour("ts"), window)
    return timed.groupBy(*keys).agg(lv.pct_at_or_above(level, threshold, inside).alias("pct"),
                                    F.count(F.when(inside, F.col(level))).alias("n"))


def share_by_period(df: DataFrame, day_threshold: float = 65.0, night_threshold: float = 55.0,
                    keys: Sequence[str] = SITE, level: str = "leq") -> DataFrame:
    timed = df.where(F.col("ts").isNotNull())
    day = lv.in_hours(F.hour("ts"), lv.DAY_LDN)
    night = lv.in_hours(F.hour("ts"), lv.NIGHT_LDN)
    return timed.groupBy(*keys).agg(
        lv.pct_at_or_above(level, day_threshold, day).alias("day_pct"),
        lv.pct_at_or_above(level, night_threshold, night).alias("night_pct"),
        F.count(F.when(day, F.col(level))).alias("n_day"),
        F.count(F.when(night, F.col(level))).alias("n_night"))


def channel_ranks(df: DataFrame, keys: Sequence[str] = SITE, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Ranked distinct levels per key and channel: the input of every descriptive statistic."""
    by = [*keys, "channel"]
    return ranks.ranked(ranks.kept_counts(by_channel(df, keys, channels), by, "level"), by)


def channel_stats(df: DataFrame, keys: Sequence[str] = SITE, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Mean, spread and shape of every channel.

    Moments merge in one pass over the readings; quartiles come from counted levels.
    """
    by = [*keys, "channel"]
    found = by_channel(df, keys, channels).where(F.col("level").isNotNull())
    moments = found.groupBy(*by).agg(
        F.count("level").alias("n"), lv.laeq("level").alias("laeq"), F.avg("level").alias("mean_arithmetic"),
        F.min("level").alias("min"), F.max("level").alias("max"), F.var_samp("level").alias("_var"),
        F.skewness("level").alias("_skew"), F.kurtosis("level").alias("_kurt"))
    quartiles = ranks.percentiles(found, by, "level", {"_q1": 0.25, "median": 0.5, "_q3": 0.75})
    variance = F.when(F.col("n") > 1, F.col("_var"))
    spread = variance > 0
    return moments.join(quartiles, by).select(
        *by, "n", "laeq", "mean_arithmetic", "median", F.sqrt(variance).alias("std_dev"), "min", "max",
        (F.col("max") - F.col("min")).alias("range"), variance.alias("variance"),
        F.when(spread, F.col("_skew")).alias("skewness"), F.when(spread, F.col("_kurt")).alias("kurtosis"),
        (F.try_divide(F.sqrt(variance), "mean_arithmetic") * 100.0).alias("cv"),
        (F.col("_q3") - F.col("_q1")).alias("iqr"))


def distribution_label(stats: DataFrame) -> DataFrame:
    """Shape label from skewness and kurtosis; undefined shape reads as non-normal."""
    skew, kurt = F.col("skewness"), F.col("kurtosis")
    return stats.withColumn(
        "distribution",
        F.when((F.abs(skew) < SKEW_LIMIT) & (F.abs(kurt) < KURTOSIS_LIMIT), "Approximately Normal")
        .when(skew > SKEW_LIMIT, "Right-skewed")
        .when(skew < -SKEW_LIMIT, "Left-skewed")
        .otherwise("Non-normal"))


def data_quality(df: DataFrame, keys: Sequence[str] = SITE, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Missing share and IQR outliers per channel; both over all rows."""
    by = [*keys, "channel"]
    r = channel_ranks(df, keys, channels)
    fences = r.groupBy(*by).agg(ranks.percentile_of_ranked(0.25).alias("q1"), ranks.percentile_of_ranked(0.75).alias("q3"))
    reach = OUTLIER_IQR * (F.col("q3") - F.col("q1"))
    beyond = (F.col("v") < F.col("q1") - reach) | (F.col("v") > F.col("q3") + reach)
    outliers = r.join(fences, by).groupBy(*by).agg(
        F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("outliers_detected"))
    rows = by_channel(df, keys, channels).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("level").isNull()).alias("n_missing"))
    found = F.coalesce(F.col("outliers_detected"), F.lit(0))
    return rows.join(outliers, by, "left").select(
        *by, (F.col("n_missing") / F.col("n_rows") * 100.0).alias("missing_percent"),
        found.alias("outliers_detected"), (found / F.col("n_rows") * 100.0).alias("outlier_percent"))


def histogram(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq", bins: int = 10) -> DataFrame:
    """Counts over equal bins of [min, max]; the last bin is closed, empty bins are kept."""
    counts = ranks.kept_counts(df, keys, level)
    span = counts.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    # a constant record has zero-width bins and falls in the closed last one
    spot = F.when(F.col("hi") == F.col("lo"), F.lit(bins - 1)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width))).cast("int")
    filled = counts.join(span, list(keys)).groupBy(*keys, spot.alias("bin")).agg(F.sum("n").alias("n"))
    spine = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (spine.join(filled, [*keys, "bin"], "left")
            .select(*keys, "bin", (F.col("lo") + width * F.col("bin")).alias("bin_start"),
                    (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_end"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def trend(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq", seq: str = "seq", least_n: int = 11) -> DataFrame:
    """Least-squares line over the reading index, from sums per slice of the record; NULL under ``least_n`` readings.

    A slice knows its local index; the number of readings before it turns local sums into global
    ones, so the index itself is never written to the readings.
    """
    part = [*keys, "_slice"]
    k = F.row_number().over(Window.partitionBy(*part).orderBy(seq)) - 1
    y = F.col(level)
    slices = (df.where(y.isNotNull()).withColumn("_slice", row_slice(seq)).withColumn("_k", k.cast("double"))
              .groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
                                  F.sum(F.col("_k") * y).alias("sky")))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0))
    s = (slices.withColumn("_o", offset).groupBy(*keys)
         .agg(F.sum("n").cast("double").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"),
              F.sum(F.col("_o") * F.col("sy") + F.col("sky")).alias("sxy")))
    n = F.col("n")
    sxx = n * (n * n - 1) / 12.0
    sxy = F.col("sxy") - (n - 1) / 2.0 * F.col("sy")
    syy = F.col("syy") - F.col("sy") * F.col("sy") / n
    slope = sxy / sxx
    # relative guard: rounding in the sums must not turn a constant record into a fitted one
    flat = syy <= F.col("syy") * 1e-13
    r2 = F.when(flat, 0.0).otherwise(sxy * sxy / (sxx * syy))
    enough = n >= least_n
    return s.select(
        *keys, n.cast("long").alias("n"), F.when(enough, slope).alias("slope"), F.when(enough, r2).alias("r_squared"),
        F.when(enough, F.when(slope > TREND_SLOPE, "Increasing").when(slope < -TREND_SLOPE, "Decreasing")
               .otherwise("Stable")).alias("trend"),
        F.when(enough, F.when(r2 > TREND_STRONG, "Strong").when(r2 > TREND_MODERATE, "Moderate")
               .otherwise("Weak")).alias("trend_strength"))


def top_decile_laeq(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq") -> DataFrame:
    """Energy average of the readings strictly above the 90th percentile."""
    r = ranks.ranked(ranks.kept_counts(df, keys, level), keys)
    cut = r.groupBy(*keys).agg(ranks.percentile_of_ranked(0.9).alias("_p90"), F.max("v").alias("max_level"))
    over = F.when(F.col("v") > F.col("_p90"), F.col("n"))
    return r.join(cut, list(keys)).groupBy(*keys).agg(
        lv.to_db(F.sum(lv.energy("v") * over) / F.sum(over)).alias("top_decile_laeq"),
        F.coalesce(F.sum(over), F.lit(0)).alias("n_top_decile"), F.max("max_level").alias("max_level"))


def record_extent(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    timed = F.col("ts").isNotNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        *[(F.count_if(timed & F.col(c).isNotNull()) > 0).alias(f"{c}_timed") for c in CHANNELS])


def key_findings(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Headline numbers: overall LAeq, loudest moment, share at or below 53 dB, loudest and quietest hour.

    Hours are reduced first (24 rows per site), so overall values are merged from them.
    """
    leq = F.col("leq")
    hours = df.groupBy(*keys, F.hour("ts").alias("hour")).agg(
        F.sum(lv.energy(leq)).alias("e"), F.count(leq).alias("n"), F.max(leq).alias("leq_max"),
        F.max("lmax").alias("lmax_max"), F.count_if(leq <= FINDINGS_DB).alias("n_low"))
    dates = (df.where(F.col("ts").isNotNull()).groupBy(*keys, F.to_date("ts").alias("d")).agg(F.lit(1).alias("x"))
             .groupBy(*keys).agg(F.count("d").alias("n_calendar_dates")))
    level = lv.to_db(F.try_divide("e", "n"))
    ok = F.col("hour").isNotNull() & (F.col("n") > 0)
    h = hours.withColumn("hl", F.when(ok, level))
    out = h.groupBy(*keys).agg(
        lv.to_db(F.try_divide(F.sum("e"), F.sum("n"))).alias("avg_laeq"),
        F.coalesce(F.max("lmax_max"), F.max("leq_max")).alias("peak"),
        F.max("leq_max").alias("peak_leq_interval"),
        F.try_divide(100.0 * F.sum("n_low"), F.sum("n")).alias("pct_at_or_below_53db"),
        F.max(F.when(ok, F.struct(F.col("hl"), -F.col("hour")))).alias("_loud"),
        F.min(F.when(ok, F.struct(F.col("hl"), F.col("hour")))).alias("_quiet"))
    return out.join(dates, list(keys), "left").select(
        *keys, "avg_laeq", "peak", "peak_leq_interval", "pct_at_or_below_53db",
        F.coalesce("n_calendar_dates", F.lit(0)).alias("n_calendar_dates"),
        (-F.col("_loud.col2")).alias("loudest_hour"), F.col("_loud.hl").alias("loudest_hour_db"),
        F.col("_quiet.hour").alias("quietest_hour"), F.col("_quiet.hl").alias("quietest_hour_db"))


def night_lamax(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Highest L-Max reading of the WHO night, 23:00-07:00."""
    night = lv.in_hours(F.hour("ts"), lv.NIGHT_LDEN)
    return df.groupBy(*keys).agg(F.max(F.when(night, F.col("lmax"))).alias("lamax_night"))


def sleep_disturbance(df: DataFrame, interval: DataFrame, keys: Sequence[str] = SITE,
                      threshold: float = SLEEP_LAMAX_DB) -> DataFrame:
    """Night L-Max above the threshold: count, share and minutes at the site's logging interval."""
    night = lv.in_hours(F.hour("ts"), lv.NIGHT_LDEN) & F.col("lmax").isNotNull()
    over = night & (F.col("lmax") > threshold)
    g = df.groupBy(*keys).agg(
        F.max(F.when(night, F.col("lmax"))).alias("lamax_night"), F.count_if(night).alias("n_night"),
        F.count_if(over).alias("n_over")).where(F.col("n_night") > 0)
    return g.join(interval, list(keys), "left").select(
        *keys, "lamax_night", "n_night", "n_over",
        (100.0 * F.col("n_over") / F.col("n_night")).alias("pct_over"),
        (F.col("n_over") * F.col("interval_s") / 60.0).alias("minutes_over"))


def channel_laeq_max(df: DataFrame, keys: Sequence[str] = SITE, channels: Sequence[str] = CHANNELS) -> DataFrame:
    return (by_channel(df, keys, channels).where(F.col("level").isNotNull()).groupBy(*keys, "channel")
            .agg(lv.laeq("level").alias("laeq"), F.max("level").alias("max_level")))

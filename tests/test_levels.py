from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import steps
from pyspark.sql import functions as F

from noisefleet.operators import aggregates as agg
from noisefleet.operators import periods as per
from noisefleet.sources import files


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_energy_average(readings):
    assert one(agg.site_laeq(readings(steps("2026-01-01", 2, 1), [60, 80])))["laeq"] == pytest.approx(77.0330, abs=1e-4)


def test_non_finite_levels_are_missing(readings):
    df = readings(steps("2026-01-01", 4, 1), [70, float("nan"), 70, float("inf")])
    assert one(agg.site_laeq(files.valid_levels(df)))["laeq"] == pytest.approx(70.0)
    none = readings(steps("2026-01-01", 2, 1), [float("nan"), None])
    assert files.valid_levels(none).count() == 0


def test_exceedance_is_linear_and_ordered(readings):
    r = one(agg.exceedance(readings(steps("2026-01-01", 101, 1), range(101))))
    assert (r["l10"], r["l50"], r["l90"]) == (90.0, 50.0, 10.0)
    v = np.random.default_rng(1).normal(55, 9, 777)
    r = one(agg.exceedance(readings(steps("2026-01-01", 777, 1), v)))
    assert r["l5"] >= r["l10"] >= r["l50"] >= r["l90"] >= r["l95"]
    assert r["l10"] == pytest.approx(np.percentile(v, 90), abs=1e-9)


def test_flat_day_ratings(readings):
    r = one(agg.rating_levels(readings(steps("2026-01-01", 1440, 60), [60.0] * 1440)))
    assert r["ldn"] == pytest.approx(66.4098, abs=1e-4) and r["lden"] == pytest.approx(66.3952, abs=1e-4)


def test_periods_weigh_by_hours_not_samples(readings):
    times = [t for h in range(24) for t in steps(f"2026-01-01 {h:02d}:00:00", 600 if 7 <= h < 22 else 6, 1)]
    assert one(agg.rating_levels(readings(times, [60.0] * len(times))))["ldn"] == pytest.approx(66.4098, abs=1e-4)


def test_missing_period_is_not_zero(readings):
    r = one(agg.rating_levels(readings(steps("2026-01-01 23:00:00", 8, 3600), [45.0] * 8)))
    assert r["ldn"] is None and r["lden"] is None and r["lnight"] == pytest.approx(45.0)


def test_energy_concentration(readings):
    r = one(agg.energy_concentration(readings(steps("2026-01-01", 1000, 1), [45.0] * 999 + [120.0])))
    assert r["dominated"] and r["n_top01pct"] == 1 and r["laeq_excluding_top01pct"] == pytest.approx(45.0)
    few = one(agg.energy_concentration(readings(steps("2026-01-01", 19, 1), [50.0] * 19)))
    assert few["n"] == 19 and few["laeq"] is None and few["dominated"] is None


def test_share_at_or_above(readings):
    df = readings(steps("2026-01-01", 100, 1), [70.0] * 30 + [40.0] * 70)
    assert one(agg.share_at_or_above(df, 65.0))["pct"] == pytest.approx(30.0)


def test_statistics_match_definitions(readings):
    v = np.round(np.random.default_rng(3).gamma(3, 4, 500) + 40, 1)
    r = agg.channel_stats(readings(steps("2026-01-01", 500, 1), v)).where("channel = 'leq'").collect()[0]
    d = v - v.mean()
    assert r["std_dev"] == pytest.approx(v.std(ddof=1)) and r["median"] == pytest.approx(np.median(v))
    assert r["skewness"] == pytest.approx((d ** 3).mean() / v.std() ** 3)
    assert r["kurtosis"] == pytest.approx((d ** 4).mean() / v.std() ** 4 - 3)
    assert r["iqr"] == pytest.approx(np.percentile(v, 75) - np.percentile(v, 25))


def test_constant_record(readings):
    df = readings(steps("2026-01-01", 50, 1), [50.0] * 50)
    label = agg.distribution_label(agg.channel_stats(df)).where("channel = 'leq'").collect()[0]
    assert label["distribution"] == "Non-normal"
    assert [r["n"] for r in agg.histogram(df).orderBy("bin").collect()] == [0] * 9 + [50]
    t = one(agg.trend(df))
    assert t["r_squared"] == 0.0 and t["trend"] == "Stable" and t["trend_strength"] == "Weak"


def test_trend_matches_polyfit(readings):
    v = 50 + 0.01 * np.arange(400) + np.random.default_rng(5).normal(0, 1, 400)
    t = one(agg.trend(readings(steps("2026-01-01", 400, 1), v)))
    slope, base = np.polyfit(np.arange(400), v, 1)
    fit = 1 - ((v - base - slope * np.arange(400)) ** 2).sum() / ((v - v.mean()) ** 2).sum()
    assert t["slope"] == pytest.approx(slope, rel=1e-9) and t["r_squared"] == pytest.approx(fit, rel=1e-9)
    assert one(agg.trend(readings(steps("2026-01-01", 10, 1), range(10))))["trend"] is None


def test_dst_day_lengths(spark):
    df = spark.sql("SELECT explode(array(DATE '2026-03-07', DATE '2026-03-08', DATE '2026-10-31', DATE '2026-11-01')) AS d")
    got = {str(r["d"]): (r["day"], r["night"]) for r in df.select(
        "d", per.period_length_s("d", (0, 0), "America/New_York").alias("day"),
        per.period_length_s("d", (22, 7), "America/New_York").alias("night")).collect()}
    assert got["2026-03-08"][0] == 23 * 3600 and got["2026-11-01"][0] == 25 * 3600
    assert got["2026-03-07"][1] == 8 * 3600 and got["2026-10-31"][1] == 10 * 3600


def test_night_belongs_to_the_evening_it_begins(readings, spark):
    df = readings(steps("2026-01-01 22:00:00", 9, 3600), [40.0 + i for i in range(9)])
    i = spark.createDataFrame([("A", 3600.0)], "site_id string, interval_s double")
    d = {str(r["date"]): r for r in per.daily_summary(df, i).collect()}
    assert set(d) == {"2026-01-01", "2026-01-02"}
    assert d["2026-01-01"]["night_coverage_pct"] == pytest.approx(100.0) and d["2026-01-02"]["night_laeq"] is None
    assert d["2026-01-01"]["night_laeq"] == pytest.approx(10 * math.log10(sum(10 ** ((40 + i) / 10) for i in range(9)) / 9))


def test_rolling_median_matches_definition(readings):
    import pandas as pd
    v = np.random.default_rng(9).normal(50, 5, 300)
    keep = [i for i in range(300) if i % 17 not in (3, 4)]
    df = readings([steps("2026-01-01", 300, 900)[i] for i in keep], v[keep])
    got = [r["rolling_median"] for r in per.rolling_median(per.resample(df, bin_s=900), window=96).orderBy("bin_start").collect()]
    s = pd.Series(np.where(np.isin(np.arange(300), keep), v, np.nan))[: keep[-1] + 1]
    w = 96
    want = s.rolling(w, center=True, min_periods=w // 2).median().where(s.notna())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a is None and np.isnan(b)) or a == pytest.approx(b)


def test_rollup_spread_agrees_with_readings(readings):
    v = np.random.default_rng(11).normal(50, 5, 500)
    df = readings(steps("2026-01-01", 500, 60), v)
    r = df.groupBy().agg(F.stddev_samp("leq").alias("s")).first()["s"]
    got = per.hour_rollup(df).groupBy("site_id").agg(per.rolled_sd().alias("s"), per.rolled_laeq().alias("l")).first()
    assert got["s"] == pytest.approx(r) and got["l"] == pytest.approx(10 * math.log10(np.mean(10 ** (v / 10))))


def test_a_site_without_any_level(readings):
    df = readings(steps("2026-01-01", 5, 1), [None] * 5)
    k = one(agg.key_findings(df))
    assert k["avg_laeq"] is None and k["pct_at_or_below_53db"] is None and k["loudest_hour"] is None and k["n_calendar_dates"] == 1
    assert one(agg.rating_levels(df.unionByName(readings(steps("2026-01-01", 1, 1), [0.0], site="B"))))["laeq_24h"] == pytest.approx(0.0)
    assert agg.channel_stats(readings(steps("2026-01-01", 2, 1), [-1.0, 1.0])).where("channel = 'leq'").first()["cv"] is None

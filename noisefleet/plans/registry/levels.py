"""Registered queries of the level aggregations."""

from __future__ import annotations

from noisefleet.operators import aggregates as agg
from noisefleet.operators import continuity
from noisefleet.plans.registry.common import Query, rounded
from noisefleet.plans.registry.sqlviews import laeq, oracle
from noisefleet.plans.views import landed, view

QUERIES: dict[str, Query] = {
    "scan_reading": lambda s, d: landed(s, d, "reading").where("leq >= 60 AND ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    .select("site_id", "ts", "leq"),
    "laeq_by_site": lambda s, d: rounded(agg.site_laeq(view(s, d, "reading"))),
    "exceedance": lambda s, d: rounded(agg.exceedance(view(s, d, "reading")), 8),
    "energy_concentration": lambda s, d: rounded(agg.energy_concentration(view(s, d, "reading"))),
    "ldn_lden": lambda s, d: rounded(agg.rating_levels(view(s, d, "reading"))),
    "pct_above": lambda s, d: rounded(agg.share_at_or_above(view(s, d, "reading"), 50.0)),
    "pct_above_window": lambda s, d: rounded(agg.share_in_window(view(s, d, "reading"), 45.0, (23, 7))),
    "pct_above_period": lambda s, d: rounded(agg.share_by_period(view(s, d, "reading"))),
    "channel_stats": lambda s, d: rounded(agg.channel_stats(view(s, d, "reading")), 8),
    "data_quality": lambda s, d: rounded(agg.data_quality(view(s, d, "reading"))),
    "histogram10": lambda s, d: rounded(agg.histogram(view(s, d, "reading")), 8),
    "distribution_label": lambda s, d: agg.distribution_label(agg.channel_stats(view(s, d, "reading")))
    .select("site_id", "channel", "distribution"),
    "trend": lambda s, d: rounded(agg.trend(view(s, d, "reading")), 6),
    "top_decile_laeq": lambda s, d: rounded(agg.top_decile_laeq(view(s, d, "reading")), 4, ["max_level"]),
    "record_extent": lambda s, d: agg.record_extent(view(s, d, "reading")),
    "key_findings": lambda s, d: rounded(agg.key_findings(view(s, d, "reading")), 4, ["peak", "peak_leq_interval"]),
    "night_lamax": lambda s, d: agg.night_lamax(view(s, d, "reading")),
    "sleep_disturbance": lambda s, d: rounded(agg.sleep_disturbance(
        view(s, d, "reading"), continuity.modal_interval(view(s, d, "reading"))), 6, ["lamax_night"]),
    "channel_laeq_max": lambda s, d: rounded(agg.channel_laeq_max(view(s, d, "reading")), 4, ["max_level"]),
}

NIGHT = "(hour(ts) >= 23 OR hour(ts) < 7)"
COMAR_NIGHT = "(hour(ts) >= 22 OR hour(ts) < 7)"
COMAR_DAY = "(hour(ts) >= 7 AND hour(ts) < 22)"
DAY = "(hour(ts) >= 7 AND hour(ts) < 19)"
EVENING = "(hour(ts) >= 19 AND hour(ts) < 23)"

RATING_WINDOWS = f"""{laeq()} AS laeq_24h, {laeq(where=COMAR_DAY)} AS laeq_day_ldn, {laeq(where=COMAR_NIGHT)} AS laeq_night_ldn,
    {laeq(where=DAY)} AS laeq_day_lden, {laeq(where=EVENING)} AS laeq_evening_lden, {laeq(where=NIGHT)} AS laeq_night_lden"""
LDN = "10 * log10((15 * pow(10::DOUBLE, laeq_day_ldn/10) + 9 * pow(10::DOUBLE, (laeq_night_ldn + 10)/10)) / 24)"
LDEN = """10 * log10((12 * pow(10::DOUBLE, laeq_day_lden/10) + 4 * pow(10::DOUBLE, (laeq_evening_lden + 5)/10)
    + 8 * pow(10::DOUBLE, (laeq_night_lden + 10)/10)) / 24)"""

STATS = """SELECT site_id, channel, count(*) AS n, 10 * log10(avg(pow(10::DOUBLE, level/10))) AS laeq, avg(level) AS mean_arithmetic,
    median(level) AS median, stddev_samp(level) AS std_dev, min(level) AS min, max(level) AS max,
    max(level) - min(level) AS range, var_samp(level) AS variance,
    (avg(level*level*level) - 3*avg(level)*avg(level*level) + 2*avg(level)*avg(level)*avg(level)) / pow(stddev_pop(level), 3) AS skewness,
    kurtosis_pop(level) AS kurtosis, stddev_samp(level) / avg(level) * 100 AS cv,
    quantile_cont(level, 0.75) - quantile_cont(level, 0.25) AS iqr FROM channels GROUP BY ALL"""
STAT_COLUMNS = ["laeq", "mean_arithmetic", "median", "std_dev", "min", "max", "range", "variance", "skewness",
                "kurtosis", "cv", "iqr"]

MODAL = """SELECT site_id, coalesce(mode_s, 1.0::DOUBLE) AS interval_s FROM (SELECT site_id,
    (arg_max(step, struct_pack(n := n, s := -step)) FILTER (WHERE step > 0)) AS mode_s FROM (
    SELECT site_id, step, count(*) AS n FROM (SELECT site_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY site_id ORDER BY ts, seq))
    AS step FROM reading) GROUP BY ALL) GROUP BY site_id)"""

TREND = """WITH t AS (SELECT site_id, leq, row_number() OVER (PARTITION BY site_id ORDER BY seq) - 1 AS x FROM reading),
        g AS (SELECT site_id, count(*) AS n, regr_slope(leq, x) AS slope, regr_r2(leq, x) AS r2 FROM t GROUP BY ALL)
        SELECT site_id, n, CASE WHEN n > 10 THEN round(slope,6) END AS slope, CASE WHEN n > 10 THEN round(r2,6) END AS r_squared,
        CASE WHEN n > 10 THEN CASE WHEN slope > 0.001 THEN 'Increasing' WHEN slope < -0.001 THEN 'Decreasing' ELSE 'Stable' END END AS trend,
        CASE WHEN n > 10 THEN CASE WHEN abs(r2) > 0.7 THEN 'Strong' WHEN abs(r2) > 0.4 THEN 'Moderate' ELSE 'Weak' END END AS trend_strength
        FROM g"""

ORACLES = {
    "scan_reading": oracle("""SELECT site_id, ts, leq FROM reading
        WHERE leq >= 60 AND ts >= TIMESTAMP '2024-01-10 00:00:00'""", "reading"),
    "laeq_by_site": oracle(f"SELECT site_id, round({laeq()}, 4) AS laeq, count(leq) AS n FROM reading GROUP BY ALL",
                           "reading"),
    "exceedance": oracle("SELECT site_id, " + ", ".join(
        f"round(quantile_cont(leq, {p}), 8) AS {n}" for n, p in
        [("l5", 0.95), ("l10", 0.9), ("l50", 0.5), ("l90", 0.1), ("l95", 0.05)])
        + " FROM reading GROUP BY ALL", "reading"),
    "energy_concentration": oracle("""WITH t AS (SELECT site_id, leq, pow(10::DOUBLE, leq/10) AS e,
        row_number() OVER (PARTITION BY site_id ORDER BY leq DESC) AS r,
        count(*) OVER (PARTITION BY site_id) AS n FROM reading),
        u AS (SELECT *, greatest(1, CAST(round_even(n * 0.001::DOUBLE, 0) AS BIGINT)) AS k FROM t),
        c AS (SELECT *, max(CASE WHEN r = k THEN leq END) OVER (PARTITION BY site_id) AS cut FROM u),
        g AS (SELECT site_id, any_value(n) AS n, any_value(k) AS k, 10*log10(sum(e)/any_value(n)) AS laeq,
              quantile_cont(leq, 0.95) AS l5, 100*max(e)/sum(e) AS top1, 100*sum(e) FILTER (WHERE r <= k)/sum(e) AS top01,
              10*log10(avg(e) FILTER (WHERE leq < cut)) AS rest FROM c GROUP BY site_id)
        SELECT site_id, n, round(laeq,4) AS laeq, round(l5,4) AS l5, round(laeq-l5,4) AS laeq_minus_l5,
        round(top1,4) AS top1_energy_pct, round(top01,4) AS top01pct_energy_pct, k AS n_top01pct,
        round(rest,4) AS laeq_excluding_top01pct, (top1 >= 10 OR laeq-l5 > 1) AS dominated FROM g""", "reading"),
    "ldn_lden": oracle(f"""WITH g AS (SELECT site_id, {RATING_WINDOWS} FROM reading GROUP BY ALL)
        SELECT site_id, round(laeq_24h,4) AS laeq_24h, round(laeq_day_ldn,4) AS laeq_day_ldn,
        round(laeq_night_ldn,4) AS laeq_night_ldn, round(laeq_day_lden,4) AS laeq_day_lden,
        round(laeq_evening_lden,4) AS laeq_evening_lden, round(laeq_night_lden,4) AS laeq_night_lden,
        round(laeq_night_lden,4) AS lnight, round({LDN},4) AS ldn, round({LDEN},4) AS lden FROM g""", "reading"),
    "pct_above": oracle("""SELECT site_id, round(100*avg(CASE WHEN leq >= 50 THEN 1.0::DOUBLE ELSE 0 END),4) AS pct
        FROM reading GROUP BY ALL""", "reading"),
    "pct_above_window": oracle(f"""SELECT site_id, round(100*avg(CASE WHEN leq >= 45 THEN 1.0::DOUBLE ELSE 0 END)
        FILTER (WHERE {NIGHT}),4) AS pct, count(leq) FILTER (WHERE {NIGHT}) AS n FROM reading GROUP BY ALL""", "reading"),
    "pct_above_period": oracle(f"""SELECT site_id,
        round(100*avg(CASE WHEN leq >= 65 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE {COMAR_DAY}),4) AS day_pct,
        round(100*avg(CASE WHEN leq >= 55 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE {COMAR_NIGHT}),4) AS night_pct,
        count(leq) FILTER (WHERE {COMAR_DAY}) AS n_day, count(leq) FILTER (WHERE {COMAR_NIGHT}) AS n_night
        FROM reading GROUP BY ALL""", "reading"),
    "channel_stats": oracle(f"WITH s AS ({STATS}) SELECT site_id, channel, n, " + ", ".join(
        f"round({c},8) AS {c}" for c in STAT_COLUMNS) + " FROM s", "channels"),
    "data_quality": oracle("""WITH q AS (SELECT site_id, channel, quantile_cont(level,0.25) AS q1,
        quantile_cont(level,0.75) AS q3 FROM channels GROUP BY ALL)
        SELECT site_id, channel, round(100.0::DOUBLE*count_if(level IS NULL)/count(*),4) AS missing_percent,
        CAST(count_if(level < q1-1.5*(q3-q1) OR level > q3+1.5*(q3-q1)) AS BIGINT) AS outliers_detected,
        round(100.0::DOUBLE*count_if(level < q1-1.5*(q3-q1) OR level > q3+1.5*(q3-q1))/count(*),4) AS outlier_percent
        FROM channels JOIN q USING (site_id, channel) GROUP BY ALL""", "channels"),
    "histogram10": oracle("""WITH m AS (SELECT site_id, min(leq) AS lo, max(leq) AS hi FROM reading GROUP BY ALL),
        c AS (SELECT site_id, CAST(least(9, floor((leq-lo)/((hi-lo)/10))) AS INT) AS bin, count(*) AS n
              FROM reading JOIN m USING (site_id) GROUP BY ALL)
        SELECT site_id, CAST(b.bin AS INT) AS bin, round(lo+(hi-lo)/10*b.bin,8) AS bin_start,
        round(lo+(hi-lo)/10*(b.bin+1),8) AS bin_end, coalesce(n,0) AS n
        FROM m CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN c USING (site_id, bin)""", "reading"),
    "distribution_label": oracle(f"""WITH s AS ({STATS}) SELECT site_id, channel,
        CASE WHEN abs(skewness) < 0.5 AND abs(kurtosis) < 3 THEN 'Approximately Normal' WHEN skewness > 0.5 THEN 'Right-skewed'
        WHEN skewness < -0.5 THEN 'Left-skewed' ELSE 'Non-normal' END AS distribution FROM s""", "channels"),
    "trend": oracle(TREND, "reading"),
    "top_decile_laeq": oracle(f"""WITH q AS (SELECT site_id, quantile_cont(leq,0.9) AS p FROM reading GROUP BY ALL)
        SELECT site_id, round({laeq(where="leq > p")},4) AS top_decile_laeq, count(*) FILTER (WHERE leq > p) AS n_top_decile,
        max(leq) AS max_level FROM reading JOIN q USING (site_id) GROUP BY ALL""", "reading"),
    "record_extent": oracle("""SELECT site_id, count(*) AS n_records, min(ts) AS start, max(ts) AS "end",
        count(leq) > 0 AS leq_timed, count(lmax) > 0 AS lmax_timed, count(lmin) > 0 AS lmin_timed FROM reading GROUP BY ALL""",
                            "reading"),
    "key_findings": oracle(f"""WITH h AS (SELECT site_id, hour(ts) AS h, {laeq()} AS l FROM reading GROUP BY ALL),
        x AS (SELECT site_id, arg_max(h, struct_pack(l := l, h := -h)) AS loud, max(l) AS lmx,
              arg_min(h, struct_pack(l := l, h := h)) AS quiet, min(l) AS lmn FROM h GROUP BY ALL)
        SELECT site_id, round({laeq()},4) AS avg_laeq, max(lmax) AS peak, max(leq) AS peak_leq_interval,
        round(100*avg(CASE WHEN leq <= 53 THEN 1.0::DOUBLE ELSE 0 END),4) AS pct_at_or_below_53db,
        count(DISTINCT ts::DATE) AS n_calendar_dates, CAST(any_value(loud) AS INT) AS loudest_hour, round(any_value(lmx),4) AS loudest_hour_db,
        CAST(any_value(quiet) AS INT) AS quietest_hour, round(any_value(lmn),4) AS quietest_hour_db
        FROM reading JOIN x USING (site_id) GROUP BY site_id""", "reading"),
    "night_lamax": oracle(f"SELECT site_id, max(lmax) FILTER (WHERE {NIGHT}) AS lamax_night FROM reading GROUP BY ALL", "reading"),
    "sleep_disturbance": oracle(f"""WITH i AS ({MODAL}) SELECT site_id, max(lmax) AS lamax_night, count(lmax) AS n_night,
        count(*) FILTER (WHERE lmax > 60) AS n_over, round(100.0::DOUBLE*count(*) FILTER (WHERE lmax > 60)/count(lmax),6) AS pct_over,
        round(count(*) FILTER (WHERE lmax > 60)*any_value(interval_s)/60,6) AS minutes_over
        FROM reading JOIN i USING (site_id) WHERE {NIGHT} GROUP BY site_id""", "reading"),
    "channel_laeq_max": oracle(f"""SELECT site_id, channel, round({laeq("level")},4) AS laeq, max(level) AS max_level
        FROM channels GROUP BY ALL""", "channels"),
}

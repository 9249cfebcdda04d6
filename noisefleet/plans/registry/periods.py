"""Registered queries of the period summaries, grids and resampled series."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisefleet.operators import aggregates as agg
from noisefleet.operators import clocks, continuity
from noisefleet.operators import periods as per
from noisefleet.plans.registry.common import Query, dates_as_text, rounded
from noisefleet.plans.registry.levels import COMAR_DAY, COMAR_NIGHT, DAY, EVENING, LDEN, LDN, MODAL, NIGHT, RATING_WINDOWS
from noisefleet.plans.registry.sqlviews import laeq, oracle
from noisefleet.plans.views import view
from noisefleet.sources import sinks


def _interval(s, d):
    return continuity.modal_interval(view(s, d, "reading"))


def _daily(s, d):
    return per.daily_summary(view(s, d, "reading"), _interval(s, d))


DAILY_EXACT = ["min_leq", "max_leq"]

QUERIES: dict[str, Query] = {
    "period_key": lambda s, d: dates_as_text(view(s, d, "reading").groupBy(
        "site_id", per.period_key("ts", 23).alias("period")).agg(F.count("leq").alias("n"))),
    "period_length": lambda s, d: dates_as_text(view(s, d, "reading").groupBy("site_id", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n")).select(
        "site_id", "date", "n", per.period_length_s("date", (22, 7), "America/New_York").alias("night_s"),
        per.period_length_s("date", (0, 0), "America/New_York").alias("day_s"))),
    "nightly_laeq": lambda s, d: rounded(per.nightly(view(s, d, "reading"), _interval(s, d)), 7),
    "lden_by_day": lambda s, d: rounded(per.lden_by_day(view(s, d, "reading"), _interval(s, d))),
    "daily_summary": lambda s, d: rounded(_daily(s, d), 7, DAILY_EXACT),
    "hourly_summary": lambda s, d: rounded(per.hourly_summary(view(s, d, "reading")), 4, DAILY_EXACT),
    "diurnal_profile": lambda s, d: per.diurnal_profile(view(s, d, "reading")).select(
        "site_id", F.posexplode("diurnal").alias("hour", "laeq")).withColumn("laeq", F.round("laeq", 4)),
    "heatmap_hour_date": lambda s, d: rounded(per.hour_date_grid(view(s, d, "reading")), 7),
    "heatmap_date_week": lambda s, d: rounded(per.date_week_grid(view(s, d, "reading"))),
    "weekly_profile": lambda s, d: rounded(per.weekly_profile(view(s, d, "reading"))),
    "hourly_box": lambda s, d: rounded(per.hourly_box(view(s, d, "reading")), 8),
    "hourly_outliers": lambda s, d: rounded(per.hourly_outliers(view(s, d, "reading")), 8),
    "hourly_outliers_top": lambda s, d: rounded(per.hourly_outliers(view(s, d, "reading"), shown=40), 8),
    "hourly_box_clipped": lambda s, d: rounded(per.hourly_box_clipped(view(s, d, "reading")), 8),
    "hourly_outliers_thinned": lambda s, d: rounded(per.thinned_outliers(view(s, d, "reading"), shown=10), 8),
    "resample_adaptive": lambda s, d: rounded(per.resample(view(s, d, "reading")), 7, ["lmax", "lmin"]),
    "resample_15min": lambda s, d: rounded(per.resample(view(s, d, "reading"), bin_s=900), 7, ["lmax", "lmin"]),
    "rolling_median": lambda s, d: rounded(per.rolling_median(per.resample(view(s, d, "reading"))), 7),
    "envelope_runs": lambda s, d: per.envelope_runs(per.resample(view(s, d, "reading"))),
    "laeq_1min": lambda s, d: rounded(per.minute_levels(clocks.ordering_key(view(s, d, "reading"))), 7),
    "periods_over_limit": lambda s, d: rounded(per.periods_over_limit(view(s, d, "reading_15m"), continuity.modal_interval(
        view(s, d, "reading_15m")))),
    "calendar_features": lambda s, d: dates_as_text(per.calendar_features(view(s, d, "reading").select("site_id", "seq", "ts"))),
    "period_levels": lambda s, d: rounded(per.period_levels(agg.rating_levels(view(s, d, "reading")))),
    "export_daily": lambda s, d: sinks.daily_export(_daily(s, d), clocks.time_basis(view(s, d, "reading"), "America/New_York")),
    "export_hourly": lambda s, d: sinks.hourly_export(per.hourly_summary(view(s, d, "reading")), clocks.time_basis(
        view(s, d, "reading"), "America/New_York")),
}


def key(start: int) -> str:
    return f"CAST(ts - INTERVAL '{start} hours' AS DATE)"


COVER = "least(100.0::DOUBLE, 100.0::DOUBLE * n * interval_s / {})"
BOX = """q AS (SELECT site_id, hour(ts) AS hour, quantile_cont(leq,0.25) AS q1, quantile_cont(leq,0.5) AS median,
    quantile_cont(leq,0.75) AS q3, min(leq) AS mn, max(leq) AS mx, 10*log10(avg(pow(10::DOUBLE,leq/10))) AS laeq
    FROM reading GROUP BY ALL), r AS (SELECT site_id, hour(ts) AS hour, seq, leq FROM reading)"""
LDEN_DAY = f"""SELECT site_id, {key(7)} AS date, {laeq(where=DAY)} AS laeq_day_lden,
    {laeq(where=EVENING)} AS laeq_evening_lden, {laeq(where=NIGHT)} AS laeq_night_lden, count(*) AS n FROM {{src}} GROUP BY ALL"""
DAILY = f"""i AS ({MODAL}), c AS (SELECT site_id, ts::DATE AS date, {laeq()} AS laeq, min(leq) AS min_leq, max(leq) AS max_leq,
    stddev_samp(leq) AS std_dev, count(*) AS n FROM reading GROUP BY ALL),
    dy AS (SELECT site_id, ts::DATE AS date, {laeq()} AS day_laeq, count(*) AS n_day FROM reading WHERE {COMAR_DAY} GROUP BY ALL),
    ng AS (SELECT site_id, {key(22)} AS date, {laeq()} AS night_laeq, count(*) AS n_night FROM reading WHERE {COMAR_NIGHT} GROUP BY ALL),
    ld AS (SELECT site_id, date, {LDEN} AS lden, n AS n_lden FROM ({LDEN_DAY.format(src="reading")})),
    daily AS (SELECT site_id, date, laeq, min_leq, max_leq, std_dev, n*interval_s/3600 AS hours_measured,
    least(100.0::DOUBLE, 100.0::DOUBLE*n*interval_s/86400) AS day_coverage_pct, day_laeq,
    least(100.0::DOUBLE, 100.0::DOUBLE*n_day*interval_s/54000) AS daytime_coverage_pct, night_laeq,
    least(100.0::DOUBLE, 100.0::DOUBLE*n_night*interval_s/32400) AS night_coverage_pct, lden,
    least(100.0::DOUBLE, 100.0::DOUBLE*n_lden*interval_s/86400) AS lden_coverage_pct
    FROM c JOIN i USING (site_id) LEFT JOIN dy USING (site_id, date) LEFT JOIN ng USING (site_id, date)
    LEFT JOIN ld USING (site_id, date))"""
DAILY_COLUMNS = ["laeq", "std_dev", "hours_measured", "day_coverage_pct", "day_laeq", "daytime_coverage_pct", "night_laeq",
                 "night_coverage_pct", "lden", "lden_coverage_pct"]
HOURLY = f"""SELECT site_id, hour(ts) AS hour, {laeq()} AS laeq, min(leq) AS min_leq, max(leq) AS max_leq,
    stddev_samp(leq) AS std_dev FROM reading GROUP BY ALL"""
CLIPPED = """f AS (SELECT *, greatest(mn, q1-1.5*(q3-q1)) AS lf, least(mx, q3+1.5*(q3-q1)) AS uf FROM q)"""
RESAMPLE = f"""bb AS (SELECT site_id, CAST(floor(epoch(ts)/@W) AS BIGINT) AS k, {laeq()} AS laeq, max(lmax) AS lmax, min(lmin) AS lmin FROM reading GROUP BY ALL),
    sn AS (SELECT site_id, unnest(range(min(k), max(k) + 1)) AS k FROM bb GROUP BY site_id),
    bins AS (SELECT site_id, make_timestamp(k*@W*1000000) AS bin_start, laeq, lmax, lmin FROM sn LEFT JOIN bb USING (site_id, k))"""
HOURS, QUARTERS = RESAMPLE.replace("@W", "3600"), RESAMPLE.replace("@W", "900")

ORACLES = {
    "period_key": oracle(f"SELECT site_id, {key(23)} AS period, count(leq) AS n FROM reading GROUP BY ALL", "reading", dates=('period',)),
    "period_length": oracle("""SELECT site_id, ts::DATE AS date, count(*) AS n, 32400.0::DOUBLE AS night_s, 86400.0::DOUBLE AS day_s
        FROM reading GROUP BY ALL""", "reading", dates=('date',)),
    "nightly_laeq": oracle(f"""WITH i AS ({MODAL}), g AS (SELECT site_id, {key(23)} AS date, {laeq()} AS laeq, count(*) AS n
        FROM reading WHERE {NIGHT} GROUP BY ALL) SELECT site_id, date, round(laeq,7) AS laeq, n,
        round({COVER.format(28800)},7) AS coverage_pct FROM g JOIN i USING (site_id)""", "reading", dates=('date',)),
    "lden_by_day": oracle(f"""WITH i AS ({MODAL}), g AS ({LDEN_DAY.format(src="reading")})
        SELECT site_id, date, round({LDEN},4) AS lden, n, round({COVER.format(86400)},4) AS coverage_pct
        FROM g JOIN i USING (site_id)""", "reading", dates=('date',)),
    "daily_summary": oracle(f"WITH {DAILY} SELECT site_id, date, min_leq, max_leq, " + ", ".join(
        f"round({c},7) AS {c}" for c in DAILY_COLUMNS) + " FROM daily", "reading", dates=('date',)),
    "hourly_summary": oracle(f"""WITH h AS ({HOURLY}) SELECT site_id, CAST(hour AS INT) AS hour, round(laeq,4) AS laeq,
        min_leq, max_leq, round(std_dev,4) AS std_dev FROM h""", "reading"),
    "diurnal_profile": oracle(f"""WITH h AS ({HOURLY}), s AS (SELECT DISTINCT site_id FROM reading)
        SELECT site_id, CAST(b.hour AS INT) AS hour, round(laeq,4) AS laeq FROM s CROSS JOIN (SELECT unnest(range(24)) AS hour) b
        LEFT JOIN h USING (site_id, hour)""", "reading"),
    "heatmap_hour_date": oracle(f"""WITH g AS (SELECT site_id, ts::DATE AS date, hour(ts) AS hour, {laeq()} AS laeq FROM reading GROUP BY ALL),
        s AS (SELECT site_id, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM g GROUP BY site_id)
        SELECT site_id, date, CAST(b.hour AS INT) AS hour, round(laeq,7) AS laeq FROM s CROSS JOIN (SELECT unnest(range(24)) AS hour) b
        LEFT JOIN g USING (site_id, date, hour)""", "reading", dates=('date',)),
    "heatmap_date_week": oracle(f"""SELECT site_id, ts::DATE AS date, CAST(week(ts) AS INT) AS week, round({laeq()},4) AS laeq
        FROM reading GROUP BY ALL""", "reading", dates=('date',)),
    "weekly_profile": oracle(f"""WITH e AS (SELECT site_id, count(DISTINCT ts::DATE) AS n_dates, count(DISTINCT isodow(ts)) AS n_weekdays FROM reading GROUP BY site_id)
        SELECT site_id, CAST(isodow(ts)-1 AS INT) AS weekday, round({laeq(where=COMAR_DAY)},4) AS day_laeq,
        round({laeq(where=f"NOT {COMAR_DAY}")},4) AS night_laeq, any_value(n_dates) AS n_dates, any_value(n_weekdays) AS n_weekdays, dayname(any_value(ts)) AS day_name
        FROM reading JOIN e USING (site_id) GROUP BY site_id, isodow(ts)""", "reading"),
    "hourly_box": oracle(f"""WITH {BOX}, w AS (SELECT site_id, hour, min(leq) AS lo, max(leq) AS hi FROM r JOIN q USING (site_id, hour)
        WHERE leq >= q1-1.5*(q3-q1) AND leq <= q3+1.5*(q3-q1) GROUP BY ALL)
        SELECT site_id, CAST(hour AS INT) AS hour, round(q1,8) AS q1, round(median,8) AS median, round(q3,8) AS q3,
        round(coalesce(lo,mn),8) AS lower_fence, round(coalesce(hi,mx),8) AS upper_fence, round(laeq,8) AS laeq
        FROM q LEFT JOIN w USING (site_id, hour)""", "reading"),
    "hourly_outliers": oracle(f"""WITH {BOX} SELECT site_id, CAST(hour AS INT) AS hour, round(leq,8) AS level, count(*) AS n, round(abs(leq-median),8) AS from_median
        FROM r JOIN q USING (site_id, hour) WHERE leq < q1-1.5*(q3-q1) OR leq > q3+1.5*(q3-q1) GROUP BY site_id, hour, leq, median""", "reading"),
    "hourly_outliers_top": oracle(f"""WITH {BOX}, o AS (SELECT site_id, hour, leq, abs(leq-median) AS far,
        row_number() OVER (PARTITION BY site_id, hour ORDER BY abs(leq-median) DESC, leq) AS k FROM r JOIN q USING (site_id, hour)
        WHERE leq < q1-1.5*(q3-q1) OR leq > q3+1.5*(q3-q1))
        SELECT site_id, CAST(hour AS INT) AS hour, round(leq,8) AS level, count(*) AS n, round(far,8) AS from_median FROM o WHERE k <= 40 GROUP BY site_id, hour, leq, far""", "reading"),
    "hourly_box_clipped": oracle(f"""WITH {BOX}, {CLIPPED}, n AS (SELECT site_id, hour, count(*) AS n FROM r JOIN f USING (site_id, hour)
        WHERE leq < lf OR leq > uf GROUP BY ALL)
        SELECT site_id, CAST(hour AS INT) AS hour, round(q1,8) AS q1, round(median,8) AS median, round(q3,8) AS q3,
        round(lf,8) AS lower_fence, round(uf,8) AS upper_fence, coalesce(n,0) AS n_outliers FROM f LEFT JOIN n USING (site_id, hour)""", "reading"),
    "hourly_outliers_thinned": oracle(f"""WITH {BOX}, {CLIPPED}, o AS (SELECT site_id, hour, leq,
        row_number() OVER (PARTITION BY site_id, hour ORDER BY leq) - 1 AS rank, count(*) OVER (PARTITION BY site_id, hour) AS m
        FROM r JOIN f USING (site_id, hour) WHERE leq < lf OR leq > uf),
        p AS (SELECT DISTINCT site_id, hour, CASE WHEN k = 9 THEN m - 1 ELSE CAST(floor(k * ((m-1)/9.0::DOUBLE)) AS BIGINT) END AS rank
        FROM (SELECT DISTINCT site_id, hour, m FROM o) CROSS JOIN (SELECT unnest(range(10)) AS k) WHERE m > 10)
        SELECT site_id, CAST(hour AS INT) AS hour, rank, round(leq,8) AS level FROM o
        WHERE m <= 10 OR (site_id, hour, rank) IN (SELECT (site_id, hour, rank) FROM p)""", "reading"),
    "resample_adaptive": oracle(f"WITH {HOURS} SELECT site_id, bin_start, round(laeq,7) AS laeq, lmax, lmin FROM bins", "reading"),
    "resample_15min": oracle(f"WITH {QUARTERS} SELECT site_id, bin_start, round(laeq,7) AS laeq, lmax, lmin FROM bins", "reading"),
    "rolling_median": oracle(f"""WITH {HOURS}, w AS (SELECT site_id, bin_start, laeq, median(laeq) OVER r AS med, count(laeq) OVER r AS c FROM bins
        WINDOW r AS (PARTITION BY site_id ORDER BY bin_start ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING))
        SELECT site_id, bin_start, round(laeq,7) AS laeq, CASE WHEN laeq IS NOT NULL AND c >= 12 THEN round(med,7) END AS rolling_median FROM w""", "reading"),
    "envelope_runs": oracle(f"""WITH {HOURS}, x AS (SELECT *, lmax IS NOT NULL AND lmin IS NOT NULL AS ok,
        row_number() OVER (PARTITION BY site_id ORDER BY bin_start) AS i FROM bins),
        y AS (SELECT *, i - row_number() OVER (PARTITION BY site_id ORDER BY bin_start) AS grp FROM x WHERE ok)
        SELECT site_id, min(bin_start) AS start, max(bin_start) AS "end", count(*) AS bins FROM y GROUP BY site_id, grp HAVING count(*) >= 2""", "reading"),
    "laeq_1min": oracle(f"""SELECT site_id, date_trunc('minute', ts) AS minute_start, '' AS second_pass, round({laeq()},7) AS laeq,
        count(*) AS readings FROM reading GROUP BY site_id, date_trunc('minute', ts)""", "reading"),
    "periods_over_limit": oracle(f"""WITH i AS ({MODAL.replace('FROM reading)', 'FROM reading_15m)')}), ng AS (SELECT site_id, {key(23)} AS date, {laeq()} AS l, count(*) AS n FROM reading_15m WHERE {NIGHT} GROUP BY ALL),
        ld AS (SELECT site_id, date, {LDEN} AS l, n FROM ({LDEN_DAY.format(src="reading_15m")})),
        cal AS (SELECT DISTINCT site_id, ts::DATE AS date FROM reading_15m),
        p AS (SELECT site_id, 'night' AS period, l, 45.0 AS lim FROM ng JOIN i USING (site_id) WHERE 100.0::DOUBLE*n*interval_s/28800 >= 50 AND l IS NOT NULL
        UNION ALL SELECT site_id, 'day', l, 53.0 FROM ld JOIN cal USING (site_id, date) JOIN i USING (site_id) WHERE 100.0::DOUBLE*n*interval_s/86400 >= 50 AND l IS NOT NULL)
        SELECT site_id, period, count(*) AS n_periods, count(*) FILTER (WHERE l > lim) AS n_over, round(min(l),4) AS lowest,
        round(max(l),4) AS highest FROM p GROUP BY ALL""", "reading_15m"),
    "calendar_features": oracle("""SELECT site_id, seq, ts, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts)-1 AS INT) AS weekday,
        dayname(ts) AS day_name, ts::DATE AS date, CAST(week(ts) AS INT) AS week FROM reading""", "reading", dates=('date',)),
    "period_levels": oracle(f"""WITH g AS (SELECT site_id, {RATING_WINDOWS} FROM reading GROUP BY ALL),
        x AS (SELECT *, {LDN} AS ldn, {LDEN} AS lden FROM g)
        SELECT site_id, 1 AS row, 'LAeq, whole record' AS metric, 'All readings' AS averaging_period, round(laeq_24h,4) AS level_db FROM x
        UNION ALL SELECT site_id, 2, 'LAeq, day', '07:00-19:00', round(laeq_day_lden,4) FROM x
        UNION ALL SELECT site_id, 3, 'LAeq, evening', '19:00-23:00', round(laeq_evening_lden,4) FROM x
        UNION ALL SELECT site_id, 4, 'Lnight', '23:00-07:00', round(laeq_night_lden,4) FROM x
        UNION ALL SELECT site_id, 5, 'Lden', 'Day + evening (+5 dB) + night (+10 dB)', round(lden,4) FROM x
        UNION ALL SELECT site_id, 6, 'LAeq, COMAR day', '07:00-22:00', round(laeq_day_ldn,4) FROM x
        UNION ALL SELECT site_id, 7, 'LAeq, COMAR night', '22:00-07:00', round(laeq_night_ldn,4) FROM x
        UNION ALL SELECT site_id, 8, 'Ldn', 'Day + night (+10 dB, 22:00-07:00)', round(ldn,4) FROM x""", "reading"),
    "export_daily": oracle(f"""WITH {DAILY} SELECT site_id, strftime(date, '%Y-%m-%d') AS "Date",
        'US Eastern, with daylight saving (EST/EDT)' AS "Time_basis", round_even(hours_measured,3) AS "Hours_measured",
        round_even(day_coverage_pct,2) AS "Day_coverage_pct", CASE WHEN day_coverage_pct < 99.5 THEN 'yes' ELSE 'no' END AS "Partial_day",
        round_even(laeq,2) AS "LAeq_00_24_dBA", round_even(min_leq,2) AS "Min_LEQ_dBA", round_even(max_leq,2) AS "Max_LEQ_dBA", round_even(std_dev,2) AS "SD_LEQ_dB",
        round_even(day_laeq,2) AS "LAeq_07_22_dBA", round_even(night_laeq,2) AS "LAeq_night_22_07_from_this_date_dBA",
        round_even(night_coverage_pct,2) AS "Night_coverage_pct", round_even(lden,2) AS "Lden_07_to_07_from_this_date_dBA",
        round_even(lden_coverage_pct,2) AS "Lden_period_coverage_pct" FROM daily""", "reading"),
    "export_hourly": oracle(f"""WITH h AS ({HOURLY}) SELECT site_id, printf('%02d:00', CAST(hour AS INT)) AS "Hour_start",
        'US Eastern, with daylight saving (EST/EDT)' AS "Time_basis", round_even(laeq,2) AS "LAeq_dBA",
        round_even(min_leq,2) AS "Min_LEQ_dBA", round_even(max_leq,2) AS "Max_LEQ_dBA", round_even(std_dev,2) AS "SD_LEQ_dB" FROM h""", "reading"),
}

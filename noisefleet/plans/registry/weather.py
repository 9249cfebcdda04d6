"""Registered queries of the weather screen."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisefleet.functions import weather as wf
from noisefleet.operators import weather as wx
from noisefleet.plans.registry.common import Query, dates_as_text, rounded
from noisefleet.plans.registry.sqlviews import oracle
from noisefleet.plans import screen
from noisefleet.plans.views import table, view
from noisefleet.sources import sinks

NY = "America/New_York"
# the test stations report every few minutes, so a block is one coverage slot
CFG = wx.ScreenConfig(slot_minutes=15)


def _minutes(s, d):
    return wx.minute_states(view(s, d, "onemin"), view(s, d, "metar"))


def _snow(s, d):
    """A daily snow record per station, in the months of the readings."""
    n = F.count(F.lit(1))
    return table(s, d, "orders").groupBy(F.concat(F.lit("ST"), F.col("o_custkey") % 2).alias("station"), F.date_add(
        F.to_date("o_orderdate"), 10592).alias("date")).agg(
        F.when(n % 5 != 4, n % 4 * 12.7).alias("snwd_mm"), F.when(n % 7 != 6, n % 2 * 25.4).alias("snow_mm"))


def _readings(s, d):
    # loggers on local standard time; every 101st time is unreadable
    return view(s, d, "reading").withColumn("station", F.concat(F.lit("ST"), F.col("file_seq") % 2)).withColumn(
        "ts", F.when(F.col("seq") % 101 != 0, F.col("ts") + F.expr("INTERVAL 3 DAYS")))


def _screen(s, d):
    return screen.build_screen(_readings(s, d), view(s, d, "onemin"), view(s, d, "metar"), _snow(s, d), CFG, NY, "local_standard")


QUERIES: dict[str, Query] = {
    "wx_ptype": lambda s, d: view(s, d, "onemin").groupBy(
        "ptype", wf.ptype_state("ptype").alias("state"), wf.ptype_kind("ptype").alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "wx_metar_parse": lambda s, d: view(s, d, "metar").select(
        "seq", *[c.alias(n) for n, c in wf.metar_flags("wxcodes", "metar").items()]),
    "wx_minute_states": lambda s, d: _minutes(s, d),
    "wx_identifier": lambda s, d: rounded(wx.assess_identifier(view(s, d, "onemin"), view(s, d, "metar"))),
    "wx_agreement": lambda s, d: rounded(wx.source_agreement(view(s, d, "onemin"), view(s, d, "metar"))),
    "wx_wind_factor": lambda s, d: rounded(view(s, d, "onemin").groupBy("station").agg(
        (F.avg("sknt") * wf.KNOT_MS * CFG.wind_factor).alias("wind_mic_ms")), 6),
    "wx_coverage": lambda s, d: wx.block_observations(_minutes(s, d), CFG).select("station", "block", "verified", "n_minutes"),
    "wx_blocks": lambda s, d: rounded(_screen(s, d).blocks),
    "snow_status": lambda s, d: dates_as_text(wx.snow_cover_status(
        view(s, d, "snow_daily"), view(s, d, "snow_daily").select("ghcnd_id", "date"), CFG)),
    "wx_apply": lambda s, d: _screen(s, d).readings.select(
        "site_id", "seq", "ts", F.coalesce("block", F.lit(-1)).alias("block"), "reason"),
    "wx_summary": lambda s, d: rounded(_screen(s, d).summary()),
    "wx_blocks_by_reason": lambda s, d: wx.blocks_by_reason(_screen(s, d).record_blocks),
    "wx_removed": lambda s, d: wx.removed_by_reason(_screen(s, d).readings.where(
        F.col("ts").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))), ["site_id"]),
    "wx_audit": lambda s, d: sinks.weather_audit(_screen(s, d).record_blocks, NY, "local_standard", ["station"]),
    "fingerprint": lambda s, d: wx.fingerprint(view(s, d, "reading")),
}

STATE1 = "CASE WHEN trim(ptype) IN ('', 'M', '--', '///') THEN NULL WHEN trim(ptype) = 'NP' THEN 0.0::DOUBLE ELSE 1.0 END"
KIND = f"CASE WHEN {STATE1} = 1 THEN CASE ptype[1] WHEN 'R' THEN 'rain' WHEN 'S' THEN 'snow' ELSE 'other' END END"
# every code group the view makes, spelled out
RAIN, SNOW = "wxcodes IN ('-RA BR', '+TSRA')", "wxcodes = 'SN'"
OTHER, THUNDER = "wxcodes = 'UP'", "wxcodes IN ('+TSRA', 'VCTS')"
STATE2 = f"CASE WHEN {RAIN} OR {SNOW} OR {OTHER} THEN 1.0::DOUBLE WHEN metar LIKE '%PWINO%' THEN NULL ELSE 0.0 END"
MINUTES = f"""mn AS (SELECT station, minute, max(state) AS state, bool_or(rain) AS rain, bool_or(snow) AS snow, bool_or(other) AS other,
    bool_or(thunder) AS thunder, bool_or(src1) AS src_1min, bool_or(NOT src1) AS src_metar, max(wind) AS wind_kt, max(peak) AS wind_peak_kt FROM (
    SELECT station, valid_utc AS minute, CASE WHEN precip > 0 THEN 1.0::DOUBLE ELSE {STATE1} END AS state, coalesce({KIND} = 'rain', false) AS rain,
        coalesce({KIND} = 'snow', false) AS snow, coalesce(coalesce({KIND}, CASE WHEN precip > 0 THEN 'other' END) = 'other', false) AS other,
        false AS thunder, true AS src1, sknt AS wind, greatest(sknt, gust_sknt) AS peak FROM onemin
    UNION ALL SELECT station, valid_utc, {STATE2}, {RAIN}, {SNOW}, {OTHER}, {THUNDER}, false, sknt, greatest(sknt, gust) FROM metar) GROUP BY ALL)"""
SHARED = f"""sh AS (SELECT o.station, o.s1, o.s1b, o.odd, m.s2 FROM
    (SELECT station, valid_utc, CASE WHEN precip > 0 THEN 1.0::DOUBLE WHEN {KIND} = 'snow' AND (tmpf-32)*5.0/9 > 5 THEN NULL ELSE {STATE1} END AS s1,
        CASE WHEN precip > 0 THEN 1.0::DOUBLE ELSE {STATE1} END AS s1b, coalesce({KIND} = 'snow' AND (tmpf-32)*5.0/9 > 5, false) AS odd FROM onemin
        QUALIFY row_number() OVER (PARTITION BY station, valid_utc ORDER BY seq DESC) = 1) o
    JOIN (SELECT station, valid_utc, {STATE2} AS s2 FROM metar QUALIFY row_number() OVER (PARTITION BY station, valid_utc ORDER BY seq DESC) = 1) m
    USING (station, valid_utc))"""
FACTOR = "(1852.0::DOUBLE/3600 * (ln(1.5::DOUBLE/0.05) / ln(10.0::DOUBLE/0.05)))"


def snow(src: str) -> str:
    """Snow status of every date of ``sp`` (key, date) from ``src`` (key, date, snwd_mm, snow_mm), day by day."""
    return f"""kd AS (SELECT k, date, max(date) FILTER (WHERE snwd_mm IS NOT NULL) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING) AS kdate, snwd_mm, snow_mm
        FROM (SELECT w.k, w.date, snwd_mm, snow_mm FROM days w LEFT JOIN {src} USING (k, date))),
    bad AS (SELECT a.k, a.date, a.snwd_mm, a.kdate, b.snwd_mm AS kdepth, (SELECT count(*) FROM kd c WHERE c.k = a.k AND c.date > a.kdate AND c.date <= a.date
        AND coalesce(c.snow_mm <> 0, true)) AS nbad FROM kd a LEFT JOIN kd b ON b.k = a.k AND b.date = a.kdate),
    st AS (SELECT k, date, CASE WHEN snwd_mm >= 25.4 THEN 'cover' WHEN snwd_mm IS NOT NULL THEN 'clear' WHEN kdepth < 25.4 AND nbad = 0 THEN 'clear' ELSE 'unknown' END AS s FROM bad),
    tri AS (SELECT k, date, [s, coalesce(lag(s) OVER w, 'unknown'), coalesce(lead(s) OVER w, 'unknown')] AS t FROM st WINDOW w AS (PARTITION BY k ORDER BY date)),
    ss AS (SELECT k, date, CASE WHEN list_contains(t, 'cover') THEN 'snow_cover' WHEN list_contains(t, 'unknown') THEN 'snow_cover_unverified' END AS status FROM tri)"""


BLOCKS = f"""{MINUTES}, b0 AS (SELECT station, CAST(epoch(minute) AS BIGINT) // 900 AS block, coalesce(max(state) = 1, false) AS precip, bool_or(thunder) AS thunder,
        bool_or(rain) AS rain, bool_or(snow) AS snow, bool_or(other) AS other, count(state) > 0 AND count(wind_kt) > 0 AS verified,
        avg(wind_kt) * {FACTOR} AS wind_mic_ms, max(wind_peak_kt) * (1852.0::DOUBLE/3600) AS wind_station_max_ms, count(*) AS n_minutes,
        count(*) FILTER (WHERE src_1min) AS n_1min, count(*) FILTER (WHERE src_metar) AS n_metar FROM mn GROUP BY ALL),
    sd AS (SELECT concat('ST', o_custkey % 2) AS k, CAST(o_orderdate AS DATE) + 10592 AS date, CASE WHEN count(*) % 5 <> 4 THEN count(*) % 4 * 12.7::DOUBLE END AS snwd_mm,
        CASE WHEN count(*) % 7 <> 6 THEN count(*) % 2 * 25.4::DOUBLE END AS snow_mm FROM orders GROUP BY ALL),
    days AS (SELECT k, CAST(unnest(generate_series((min(date) - 5)::TIMESTAMP, greatest(max(date), (SELECT max(minute)::DATE + 5 FROM mn))::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM sd GROUP BY k),
    {snow("sd")},
    sp AS (SELECT concat('ST', file_seq % 2) AS station, unnest(range(CAST(epoch(min(ts)) AS BIGINT) // 900 + 306, CAST(epoch(max(ts)) AS BIGINT) // 900 + 311)) AS block
        FROM reading WHERE seq % 101 <> 0 GROUP BY file_seq % 2),
    b1 AS (SELECT sp.station, sp.block, coalesce(precip, false) AS precip, coalesce(thunder, false) AS thunder, coalesce(rain, false) AS rain, coalesce(snow, false) AS snow,
        coalesce(other, false) AS other, coalesce(verified, false) AS verified, wind_mic_ms, wind_station_max_ms, coalesce(n_minutes, 0) AS n_minutes,
        coalesce(n_1min, 0) AS n_1min, coalesce(n_metar, 0) AS n_metar, make_timestamp(sp.block * 900000000) AS block_start_utc, status AS snow_status
        FROM sp LEFT JOIN b0 USING (station, block) LEFT JOIN ss ON ss.k = sp.station AND ss.date = CAST(make_timestamp(sp.block * 900000000) - INTERVAL 5 HOUR AS DATE)),
    b2 AS (SELECT *, coalesce(lag(precip OR thunder) OVER w, false) OR coalesce(lead(precip OR thunder) OVER w, false) AS buf,
        NOT verified OR coalesce(lag(NOT verified) OVER w, false) OR coalesce(lead(NOT verified) OVER w, false) AS unv FROM b1 WINDOW w AS (PARTITION BY station ORDER BY block)),
    blk AS (SELECT * EXCLUDE (buf, unv), CASE WHEN precip THEN 'precipitation' WHEN thunder THEN 'thunder' WHEN wind_mic_ms > 5 THEN 'wind'
        WHEN snow_status = 'snow_cover' THEN 'snow_cover' WHEN buf THEN 'precip_buffer' WHEN snow_status = 'snow_cover_unverified' THEN 'snow_cover_unverified'
        WHEN unv THEN 'weather_unverified' END AS reason FROM b2)"""
SCREEN = f"""{BLOCKS}, rd AS (SELECT concat('ST', file_seq % 2) AS station, site_id, seq, CASE WHEN seq % 101 <> 0 THEN ts + INTERVAL 3 DAY END AS ts FROM reading),
    rb AS (SELECT *, CAST(epoch(ts + INTERVAL 5 HOUR) AS BIGINT) // 900 AS block FROM rd),
    rr AS (SELECT station, min(block) AS a, max(block) AS b FROM rb GROUP BY station),
    inb AS (SELECT blk.* FROM blk JOIN rr USING (station) WHERE block BETWEEN a AND b),
    scr AS (SELECT station, site_id, seq, ts, rb.block, CASE WHEN ts IS NULL THEN 'clock_ambiguous' WHEN inb.block IS NULL THEN 'weather_unverified' ELSE inb.reason END AS reason
        FROM rb LEFT JOIN inb USING (station, block))"""
WX = ("onemin", "metar")
ALL = ("onemin", "metar", "reading")
R4 = "round(wind_mic_ms,4) AS wind_mic_ms, round(wind_station_max_ms,4) AS wind_station_max_ms"

ORACLES = {
    "fingerprint": oracle("""SELECT site_id, CAST(sum(CAST(concat('0x', substr(md5(concat(seq, '|', CAST(epoch_us(ts) AS BIGINT))), 1, 15)) AS BIGINT)::HUGEINT) AS VARCHAR) AS timestamp_hash,
        count(*) AS rows, min(ts) AS start, max(ts) AS "end" FROM reading GROUP BY ALL""", "reading"),
    "wx_ptype": oracle(f"SELECT ptype, {STATE1} AS state, {KIND} AS kind, count(*) AS n FROM onemin GROUP BY ALL", "onemin"),
    "wx_metar_parse": oracle(f"""SELECT seq, {STATE2} AS state, {RAIN} AS rain, {SNOW} AS snow, {OTHER} AS other, {THUNDER} AS thunder,
        {SNOW} AS frozen FROM metar""", "metar"),
    "wx_minute_states": oracle(f"WITH {MINUTES} SELECT * FROM mn", *WX),
    "wx_identifier": oracle(f"""WITH {SHARED}, g AS (SELECT station, count(*) FILTER (WHERE s1 IS NOT NULL AND s2 IS NOT NULL) AS n,
        count(*) FILTER (WHERE s1 = 1 AND s2 = 0) AS o, count(*) FILTER (WHERE s1 = s2) AS a, count(*) FILTER (WHERE odd) AS odd FROM sh GROUP BY ALL)
        SELECT station, CASE WHEN n >= 200 THEN o::DOUBLE/n <= 0.2 END AS reliable, n AS minutes_compared,
        CASE WHEN n >= 200 THEN round(100.0::DOUBLE*o/n,4) END AS only_1min_pct, CASE WHEN n >= 200 THEN round(100.0::DOUBLE*a/n,4) END AS agree_pct,
        odd AS impossible_snow_minutes FROM g""", *WX),
    "wx_agreement": oracle(f"""WITH {SHARED} SELECT station, count(*) AS minutes_compared, round(100.0::DOUBLE*count_if(s1b = s2)/count(*),4) AS agree_pct,
        count(*) FILTER (WHERE s1b = 1 AND s2 = 1) AS both_precip, count(*) FILTER (WHERE s1b = 1 AND s2 = 0) AS only_1min_precip,
        count(*) FILTER (WHERE s1b = 0 AND s2 = 1) AS only_metar_precip FROM sh WHERE s1b IS NOT NULL AND s2 IS NOT NULL GROUP BY ALL""", *WX),
    "wx_wind_factor": oracle(f"SELECT station, round(avg(sknt) * {FACTOR},6) AS wind_mic_ms FROM onemin GROUP BY ALL", "onemin"),
    "wx_coverage": oracle(f"""WITH {MINUTES} SELECT station, CAST(epoch(minute) AS BIGINT) // 900 AS block, count(state) > 0 AND count(wind_kt) > 0 AS verified,
        count(*) AS n_minutes FROM mn GROUP BY ALL""", *WX),
    "wx_blocks": oracle(f"WITH {SCREEN} SELECT * EXCLUDE (wind_mic_ms, wind_station_max_ms), {R4} FROM blk", *ALL),
    "snow_status": oracle(f"""WITH sd AS (SELECT ghcnd_id AS k, date, snwd_mm, snow_mm FROM snow_daily), days AS (SELECT k, CAST(unnest(generate_series(min(date)::TIMESTAMP,
        max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM sd GROUP BY k), {snow("sd")}
        SELECT k AS ghcnd_id, date, status FROM ss JOIN sd USING (k, date) WHERE status IS NOT NULL""", "snow_daily", dates=("date",)),
    "wx_apply": oracle(f"WITH {SCREEN} SELECT * EXCLUDE (station) REPLACE (coalesce(block, -1) AS block) FROM scr", *ALL),
    "wx_summary": oracle(f"""WITH {SCREEN}, a AS (SELECT station, count(*) AS samples_total, count(*) FILTER (WHERE ts IS NULL) AS samples_unreadable_time,
        count(*) FILTER (WHERE reason IS NULL) AS samples_kept, count(reason) AS samples_excluded, round(100.0::DOUBLE*count(*) FILTER (WHERE reason IS NULL)/count(*),4) AS pct_kept,
        min(ts) AS record_start_local, max(ts) AS record_end_local FROM scr GROUP BY station),
        b AS (SELECT station, count(*) AS blocks_total, count(*) FILTER (WHERE reason IS NULL) AS blocks_clean, round(100.0::DOUBLE*count(*) FILTER (WHERE n_1min > 0)/count(*),4) AS blocks_with_1min_pct,
        round(100.0::DOUBLE*count(*) FILTER (WHERE verified)/count(*),4) AS blocks_verified_pct, round(max(wind_mic_ms),4) AS max_block_wind_mic_ms FROM inb GROUP BY ALL),
        m AS (SELECT station, count(*) FILTER (WHERE rain) AS rain_minutes, count(*) FILTER (WHERE snow) AS snow_minutes, count(*) FILTER (WHERE other) AS other_minutes
        FROM mn JOIN (SELECT station, min(block) AS lo, max(block) AS hi FROM inb GROUP BY station) USING (station) WHERE CAST(epoch(minute) AS BIGINT) // 900 BETWEEN lo AND hi GROUP BY ALL)
        SELECT * FROM a JOIN b USING (station) JOIN m USING (station)""", *ALL),
    "wx_blocks_by_reason": oracle(f"WITH {SCREEN} SELECT station, coalesce(reason, 'clean') AS reason, count(*) AS n FROM inb GROUP BY ALL", *ALL),
    "wx_removed": oracle(f"""WITH {SCREEN} SELECT site_id, reason, count(*) AS n FROM scr WHERE reason IS NOT NULL
        AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY ALL""", *ALL),
    "wx_audit": oracle(f"""WITH {SCREEN} SELECT station, strftime(block_start_utc - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS block_start_logger_clock,
        strftime(block_start_utc, '%Y-%m-%d %H:%M') AS block_start_utc, coalesce(reason, 'clean') AS status, verified AS weather_verified, precip AS precipitation,
        rain, snow, other AS other_precip, thunder, round_even(wind_mic_ms,2) AS estimated_mean_wind_at_mic_m_s,
        round_even(wind_station_max_ms,2) AS maximum_station_wind_or_gust_m_s, n_1min AS minutes_1min_obs, n_metar AS minutes_metar_obs FROM inb""", *ALL),
}

"""Registered queries of clock handling, on readings moved to months with a daylight-saving change."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.operators import clocks, continuity
from noisefleet.operators import periods as per
from noisefleet.plans.registry.common import Query, rounded
from noisefleet.plans.registry.levels import MODAL
from noisefleet.plans.registry.sqlviews import laeq, oracle
from noisefleet.plans.views import view

NY = "America/New_York"


QUERIES: dict[str, Query] = {
    "fold_mark": lambda s, d: clocks.mark_repeated_hour(view(s, d, "autumn_15m")).select("site_id", "seq", "ts", "fold"),
    "ordering_key": lambda s, d: clocks.ordering_key(clocks.mark_repeated_hour(view(s, d, "autumn_15m"))).select(
        "site_id", "seq", "ts", "ord_ts"),
    "clock_convert": lambda s, d: clocks.convert_clock(view(s, d, "reading_october"), NY, "UTC").select("site_id", "seq", "ts"),
    "clock_convert_fold": lambda s, d: clocks.convert_clock(view(s, d, "reading_october").withColumn("fold", F.lit(0)), "UTC", NY)
    .select("site_id", "seq", "ts", "fold"),
    "skipped_readings": lambda s, d: clocks.skipped_readings(view(s, d, "reading_march"), NY),
    "local_to_utc": lambda s, d: view(s, d, "reading_march").select(
        "site_id", "seq", "ts", *[ck.logger_to_utc("ts", NY, m).alias(f"utc_{m}") for m in ("utc", "local_standard", "local_dst")]),
    "local_to_utc_autumn": lambda s, d: view(s, d, "reading_october").select(
        "site_id", "seq", ck.logger_to_utc("ts", NY, "local_dst").alias("utc")),
    "clock_changes": lambda s, d: continuity.clock_changes(view(s, d, "spring_15m"), NY),
    "logger_clock": lambda s, d: clocks.describe_logger_clock(view(s, d, "spring_15m"), NY),
    "logger_clock_autumn": lambda s, d: clocks.describe_logger_clock(clocks.mark_repeated_hour(view(s, d, "autumn_15m")), NY),
    "clock_check": lambda s, d: clocks.check_clock_setting(view(s, d, "reading_march"), NY, "local_dst"),
    "clock_check_standard": lambda s, d: clocks.check_clock_setting(
        view(s, d, "spring_15m").withColumn("ts", ck.plus_seconds("ts", F.when(F.minute("ts") == 45, 14 * 60 + 30.0).otherwise(5.0))), NY, "local_standard"),
    "time_basis": lambda s, d: clocks.time_basis(view(s, d, "reading_march"), "Europe/Berlin"),
    "laeq_1min_autumn": lambda s, d: rounded(per.minute_levels(clocks.ordering_key(
        clocks.mark_repeated_hour(view(s, d, "autumn_15m")))), 6),
}

FOLD = """a AS (SELECT *, lag(ts) OVER (PARTITION BY site_id ORDER BY seq) AS prev FROM autumn_15m),
    b AS (SELECT *, coalesce(abs(epoch(ts) - epoch(prev) + 3600) <= 1800, false) AS jump FROM a),
    c AS (SELECT *, sum(CASE WHEN jump THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY seq) AS jid,
        last_value(CASE WHEN jump THEN prev END IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY seq) AS peak FROM b),
    f AS (SELECT *, CAST(CASE WHEN jid > 0 AND sum(CASE WHEN ts > peak THEN 1 ELSE 0 END) OVER (PARTITION BY site_id, jid ORDER BY seq) = 0
        THEN 1 ELSE 0 END AS TINYINT) AS fold2 FROM c),
    lf AS (SELECT site_id, max(ts) AS last_fold FROM f WHERE fold2 = 1 GROUP BY ALL),
    o AS (SELECT f.*, CASE WHEN fold2 = 1 OR ts > last_fold THEN ts + INTERVAL 1 HOUR ELSE ts END AS ord_ts FROM f LEFT JOIN lf USING (site_id))"""

ORACLES = {
    "fold_mark": oracle(f"WITH {FOLD} SELECT site_id, seq, ts, fold2 AS fold FROM f", "autumn_15m"),
    "ordering_key": oracle(f"WITH {FOLD} SELECT site_id, seq, ts, ord_ts FROM o", "autumn_15m"),
    "clock_convert": oracle("""SELECT site_id, seq, CASE WHEN ts < TIMESTAMP '2024-11-03 01:00:00' OR (ts < TIMESTAMP '2024-11-03 02:00:00' AND fold = 0)
        THEN ts + INTERVAL 4 HOUR ELSE ts + INTERVAL 5 HOUR END AS ts FROM reading_october""", "reading_october"),
    "clock_convert_fold": oracle("""SELECT site_id, seq, CASE WHEN ts < TIMESTAMP '2024-11-03 06:00:00' THEN ts - INTERVAL 4 HOUR ELSE ts - INTERVAL 5 HOUR END AS ts,
        CAST(CASE WHEN ts >= TIMESTAMP '2024-11-03 06:00:00' AND ts < TIMESTAMP '2024-11-03 07:00:00' THEN 1 ELSE 0 END AS TINYINT) AS fold
        FROM reading_october""", "reading_october"),
    "skipped_readings": oracle("""SELECT site_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-03-10 02:00:00' AND ts < TIMESTAMP '2024-03-10 03:00:00')
        AS nonexistent_source_readings FROM reading_march GROUP BY ALL""", "reading_march"),
    "local_to_utc": oracle("""SELECT site_id, seq, ts, ts AS utc_utc, ts + INTERVAL 5 HOUR AS utc_local_standard,
        CASE WHEN ts < TIMESTAMP '2024-03-10 02:00:00' THEN ts + INTERVAL 5 HOUR WHEN ts >= TIMESTAMP '2024-03-10 03:00:00' THEN ts + INTERVAL 4 HOUR END AS utc_local_dst
        FROM reading_march""", "reading_march"),
    "local_to_utc_autumn": oracle("""SELECT site_id, seq, CASE WHEN ts < TIMESTAMP '2024-11-03 01:00:00' THEN ts + INTERVAL 4 HOUR
        WHEN ts >= TIMESTAMP '2024-11-03 02:00:00' THEN ts + INTERVAL 5 HOUR END AS utc FROM reading_october""", "reading_october"),
    "clock_changes": oracle(f"""WITH i AS ({MODAL.replace('FROM reading)', 'FROM reading_15m)')}), a AS (SELECT site_id, lag(ts) OVER (PARTITION BY site_id ORDER BY ts) AS before, ts AS after FROM spring_15m),
        b AS (SELECT *, CASE WHEN before < TIMESTAMP '2024-03-10 02:00:00' AND after >= TIMESTAMP '2024-03-10 03:00:00' THEN 3600.0::DOUBLE ELSE 0 END AS shift_seconds FROM a)
        SELECT site_id, before, after, shift_seconds, epoch(after) - epoch(before) - shift_seconds AS elapsed_seconds FROM b JOIN i USING (site_id)
        WHERE epoch(after) - epoch(before) > greatest(2*interval_s, 2) AND shift_seconds >= 3600 - interval_s""", "reading_15m", "spring_15m"),
    "logger_clock": oracle("""WITH a AS (SELECT site_id, lag(ts) OVER (PARTITION BY site_id ORDER BY ts) AS before, ts AS after FROM spring_15m)
        SELECT site_id, true AS follows_dst, concat('Follows summer time. ', strftime(after, '%d %b %Y'), ': ', strftime(before, '%H:%M:%S'), ' is followed by ', strftime(after, '%H:%M:%S')) AS evidence
        FROM a WHERE before < TIMESTAMP '2024-03-10 02:00:00' AND after >= TIMESTAMP '2024-03-10 03:00:00'""", "spring_15m"),
    "logger_clock_autumn": oracle(f"""WITH {FOLD} SELECT site_id, count(*) FILTER (WHERE fold2 = 1) > 0 AS follows_dst,
        CASE WHEN count(*) FILTER (WHERE fold2 = 1) > 0 THEN concat('Follows summer time. ', strftime(min(ts) FILTER (WHERE fold2 = 1), '%d %b %Y'), ': an hour appears two times')
        ELSE 'Keeps one offset. The zone changed on 03 Nov 2024 and the times run on.' END AS evidence
        FROM f GROUP BY ALL""", "autumn_15m"),
    "clock_check": oracle("""WITH g AS (SELECT site_id, count(*) AS n FROM reading_march WHERE ts >= TIMESTAMP '2024-03-10 02:00:00' AND ts < TIMESTAMP '2024-03-10 03:00:00' GROUP BY ALL)
        SELECT site_id, TIMESTAMP '2024-03-10 02:00:00' AS skipped_hour, n AS n_inside, concat(n, ' readings lie from 02:00 to 03:00 on 10 Mar 2024, which America/New_York left out; set the clock to standard time.') AS contradiction FROM g""", "reading_march"),
    "clock_check_standard": oracle("""WITH t AS (SELECT site_id, ts + CASE WHEN minute(ts) = 45 THEN to_seconds(870) ELSE to_seconds(5) END AS ts FROM spring_15m),
        n AS (SELECT site_id, max(ts) FILTER (WHERE ts >= TIMESTAMP '2024-03-10 01:59:00' AND ts < TIMESTAMP '2024-03-10 02:00:00') AS b,
            min(ts) FILTER (WHERE ts >= TIMESTAMP '2024-03-10 03:00:00' AND ts < TIMESTAMP '2024-03-10 03:01:00') AS a,
            count(*) FILTER (WHERE ts >= TIMESTAMP '2024-03-10 02:00:00' AND ts < TIMESTAMP '2024-03-10 03:00:00') AS n FROM t GROUP BY ALL)
        SELECT site_id, TIMESTAMP '2024-03-10 02:00:00' AS skipped_hour, n AS n_inside, concat('From ', strftime(b, '%H:%M:%S'), ' the times go on at ', strftime(a, '%H:%M:%S'),
        ' on 10 Mar 2024, where America/New_York left an hour out; set the clock to summer time.') AS contradiction FROM n WHERE n = 0 AND a IS NOT NULL AND b IS NOT NULL""", "spring_15m"),
    "time_basis": oracle("""SELECT site_id, CASE WHEN max(ts) >= TIMESTAMP '2024-03-30 00:00:00' THEN 'CET/CEST' ELSE 'CET' END AS abbreviations,
        'Central Europe (CET/CEST)' AS time_basis FROM reading_march GROUP BY ALL""", "reading_march"),
    "laeq_1min_autumn": oracle(f"""WITH {FOLD} SELECT site_id, ts AS minute_start, CASE WHEN fold2 = 1 THEN 'yes' ELSE '' END AS second_pass,
        round({laeq()},6) AS laeq, count(*) AS readings FROM o GROUP BY site_id, ts, fold2, ord_ts""", "autumn_15m"),
}

"""Registered queries of gaps, completeness, merging and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisefleet.operators import aggregates as agg
from noisefleet.operators import continuity as con
from noisefleet.operators import filters as flt
from noisefleet.operators import peaks
from noisefleet.plans import ingest
from noisefleet.plans.registry.common import Query, rounded
from noisefleet.plans.registry.levels import MODAL, TREND
from noisefleet.plans.registry.sqlviews import oracle
from noisefleet.plans.views import exclusions, view


def _r15(s, d):
    return view(s, d, "reading_15m")


def _merged(s, d):
    return ingest.merge_sites(view(s, d, "reading_files"))[0]


def _peaks(df):
    return rounded(peaks.peak_summary(df).withColumns(
        {c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ") for c in ("top5_by_level", "last5_in_time")}), 6)


QUERIES: dict[str, Query] = {
    "modal_interval": lambda s, d: con.modal_interval(view(s, d, "reading")),
    "gaps": lambda s, d: con.gaps(_r15(s, d), exclusions=exclusions(s, d)),
    "gap_summary": lambda s, d: rounded(con.gap_summary(_r15(s, d), exclusions=exclusions(s, d)), 6),
    "excluded_gaps": lambda s, d: con.excluded_gaps(_r15(s, d), exclusions(s, d)),
    "completeness": lambda s, d: rounded(con.completeness(_r15(s, d)), 6),
    "merge_dedupe": lambda s, d: con.merge_files(view(s, d, "reading"))[0],
    "merge_notes": lambda s, d: con.merge_files(view(s, d, "reading"))[1],
    "file_details": lambda s, d: con.file_details(view(s, d, "reading")),
    "noise_events": lambda s, d: con.noise_events(view(s, d, "reading")).drop("peak_key"),
    "top_events": lambda s, d: con.top_events(con.noise_events(view(s, d, "reading"))),
    "peaks": lambda s, d: _peaks(view(s, d, "reading")),
    "merged_peaks": lambda s, d: _peaks(_merged(s, d)),
    "merged_trend": lambda s, d: rounded(agg.trend(_merged(s, d)), 6),
    "merged_windows": lambda s, d: flt.removed_windows(flt.mark_kept(_merged(s, d), "2024-01-03", "2024-01-25", exclusions(s, d))),
}

DURATION = """CASE WHEN {s} >= 3600 THEN CASE WHEN {s} % 3600 // 60 > 0 THEN concat({s} // 3600, ' h ', {s} % 3600 // 60, ' min') ELSE concat({s} // 3600, ' h') END
    WHEN {s} >= 60 THEN CASE WHEN {s} % 60 > 0 THEN concat({s} // 60, ' min ', {s} % 60, ' s') ELSE concat({s} // 60, ' min') END ELSE concat({s}, ' s') END"""
EXCLUSIONS = """x AS (SELECT event_type AS site_id, date_trunc('day', min(ts)) + INTERVAL 4 DAY AS start,
    date_trunc('day', min(ts)) + INTERVAL 5 DAY - INTERVAL 1 SECOND AS "end" FROM events GROUP BY event_type)"""
STEPS = f"""i AS ({MODAL.replace('FROM reading)', 'FROM reading_15m)')}), st AS (SELECT site_id, ts, lag(ts) OVER (PARTITION BY site_id ORDER BY ts) AS prev FROM reading_15m),
    g0 AS (SELECT site_id, prev, ts, epoch(ts) - epoch(prev) AS step, interval_s FROM st JOIN i USING (site_id)
           WHERE epoch(ts) - epoch(prev) > greatest(2*interval_s, 2)),
    g AS (SELECT g0.*, x.start IS NOT NULL AS excl, x.start, x."end" FROM g0 LEFT JOIN x ON g0.site_id = x.site_id
          AND prev >= x.start - to_seconds(CAST(interval_s AS BIGINT)) AND ts <= x."end" + to_seconds(CAST(interval_s AS BIGINT)) AND prev < x."end" AND ts > x.start)"""
EVENTS = """t AS (SELECT site_id, quantile_cont(leq,0.9) AS p FROM reading GROUP BY ALL),
    a AS (SELECT site_id, ts, seq, leq, lag(ts) OVER w AS prev, lag(leq) OVER w AS pl FROM reading WINDOW w AS (PARTITION BY site_id ORDER BY ts, seq)),
    md AS (SELECT site_id, median(floor(epoch(ts) - epoch(prev))) AS m FROM a WHERE prev IS NOT NULL GROUP BY ALL),
    b AS (SELECT a.*, p, m, leq >= p AS above, leq >= p AND NOT coalesce(pl >= p AND epoch(ts) - epoch(prev) <= greatest(3*m, 3), false) AS begins
        FROM a JOIN t USING (site_id) JOIN md USING (site_id)),
    c AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY ts, seq) AS event_id FROM b),
    e AS (SELECT site_id, CAST(event_id AS BIGINT) AS event_id, min(ts) AS start, max(ts) AS "end",
        arg_max(ts, struct_pack(l := leq, t := -epoch(ts), s := -seq)) AS peak_time, max(leq) AS peak,
        epoch(max(ts)) - epoch(min(ts)) + any_value(m) AS duration_s, count(*) AS n_readings FROM c WHERE above GROUP BY site_id, event_id)"""

PEAKS = """x AS (SELECT site_id, leq AS v, row_number() OVER (PARTITION BY site_id ORDER BY seq) AS i FROM reading),
    sd AS (SELECT site_id, stddev_samp(leq) AS sd, count(*) AS n, max(leq) AS mx, quantile_cont(leq, 0.9) AS p90 FROM reading GROUP BY ALL),
    ch AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY site_id ORDER BY i) AS pv FROM x) WHERE pv IS NULL OR pv <> v),
    lm AS (SELECT site_id, i, v FROM (SELECT *, lead(v) OVER (PARTITION BY site_id ORDER BY i) AS nv FROM ch) WHERE v > pv AND nv < v),
    j AS (SELECT lm.site_id, lm.i, lm.v, max(x.i) FILTER (WHERE x.i < lm.i AND x.v <= lm.v - sd) AS ll, max(x.i) FILTER (WHERE x.i < lm.i AND x.v > lm.v) AS lh,
        min(x.i) FILTER (WHERE x.i > lm.i AND x.v <= lm.v - sd) AS rl, min(x.i) FILTER (WHERE x.i > lm.i AND x.v > lm.v) AS rh
        FROM lm JOIN sd USING (site_id) JOIN x ON x.site_id = lm.site_id GROUP BY lm.site_id, lm.i, lm.v),
    pk AS (SELECT site_id, i, v, row_number() OVER (PARTITION BY site_id ORDER BY v DESC, i) AS a, row_number() OVER (PARTITION BY site_id ORDER BY i DESC) AS b
        FROM j WHERE ll > coalesce(lh, 0) AND rl < coalesce(rh, 1000000000))"""

PEAK_SUMMARY = f"""WITH {PEAKS}, td AS (SELECT site_id, 10*log10(avg(pow(10::DOUBLE, leq/10))) AS t FROM reading JOIN sd USING (site_id) WHERE leq > p90 GROUP BY ALL)
        SELECT site_id, count(i) AS number_of_peaks, coalesce(string_agg(v::VARCHAR, ' ' ORDER BY a) FILTER (WHERE a <= 5), '') AS top5_by_level,
        coalesce(string_agg(v::VARCHAR, ' ' ORDER BY i) FILTER (WHERE b <= 5), '') AS last5_in_time, round(count(i)*1000.0::DOUBLE/any_value(n),6) AS peaks_per_1000,
        round(any_value(t),6) AS top_decile_laeq, round(any_value(mx),6) AS max_peak FROM sd LEFT JOIN pk USING (site_id) LEFT JOIN td USING (site_id) GROUP BY site_id"""

ORACLES = {
    "peaks": oracle(PEAK_SUMMARY, "reading"),
    "merged_peaks": oracle(PEAK_SUMMARY.replace("FROM reading", "FROM reading_merged"), "reading_merged"),
    "merged_trend": oracle(TREND.replace("FROM reading", "FROM reading_merged"), "reading_merged"),
    "merged_windows": oracle(f"""WITH {EXCLUSIONS}, m AS (SELECT r.*, ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-26'
        AND NOT coalesce(ts >= x.start AND ts <= x."end", false) AS kept FROM reading_merged r LEFT JOIN x USING (site_id)),
        b AS (SELECT *, seq - row_number() OVER (PARTITION BY site_id ORDER BY seq) AS grp FROM m WHERE NOT kept)
        SELECT site_id, min(ts) AS start, max(ts) AS "end", count(*) AS n_removed FROM b GROUP BY site_id, grp""", "reading_merged"),
    "modal_interval": oracle(MODAL, "reading"),
    "gaps": oracle(f"""WITH {EXCLUSIONS}, {STEPS}, m AS (SELECT *, greatest(0, step - interval_s) AS missing, CAST(step - interval_s AS BIGINT) AS s FROM g WHERE NOT excl)
        SELECT site_id, prev AS gap_start, ts AS gap_end, step AS duration_seconds, missing AS missing_seconds, {DURATION.format(s="s")} AS duration_human,
        CASE WHEN missing/60 < 15 THEN 'Minor' ELSE 'Major' END AS category,
        concat({DURATION.format(s="s")}, ' missing after ', strftime(prev, '%Y-%m-%d %H:%M:%S'), ', up to ', strftime(ts, '%Y-%m-%d %H:%M:%S')) AS label
        FROM m""", "reading_15m"),
    "excluded_gaps": oracle(f"""WITH {EXCLUSIONS}, {STEPS} SELECT site_id, start, "end", step AS step_seconds FROM g WHERE excl""", "reading_15m"),
    "gap_summary": oracle(f"""WITH {EXCLUSIONS}, {STEPS}, b AS (SELECT site_id, count(*) AS total_rows, epoch(max(ts)) - epoch(min(ts)) AS span FROM reading_15m GROUP BY ALL),
        q AS (SELECT site_id, count(*) FILTER (WHERE NOT excl) AS gc, count(*) FILTER (WHERE NOT excl AND (step-interval_s)/60 < 15) AS mn,
              coalesce(sum(greatest(0, step-interval_s)) FILTER (WHERE NOT excl), 0) AS missing, coalesce(sum(greatest(0, step-interval_s)) FILTER (WHERE excl), 0) AS ex,
              count(*) FILTER (WHERE interval_s >= 3600) AS cc FROM g GROUP BY ALL),
        z AS (SELECT site_id, total_rows, span, interval_s, coalesce(gc,0) AS gc, coalesce(mn,0) AS mn, coalesce(missing,0) AS missing, coalesce(ex,0) AS ex, coalesce(cc,0) AS cc,
              greatest(CAST(round_even((span - coalesce(ex,0))/interval_s, 0) AS BIGINT) + 1, total_rows) AS expected FROM b JOIN i USING (site_id) LEFT JOIN q USING (site_id)),
        y AS (SELECT *, least(100, total_rows::DOUBLE/expected*100) AS c FROM z)
        SELECT site_id, total_rows, round(interval_s,6) AS logging_interval_seconds, round(span,6) AS actual_span_seconds, expected AS expected_rows,
        round(c,6) AS completeness_exact, floor(c*100)/100 AS uptime_pct, gc AS gap_count, mn AS minor_gap_count, gc - mn AS major_gap_count,
        round(missing::DOUBLE,6) AS missing_seconds, cc AS n_clock_changes, gc = 0 AS continuous FROM y""", "reading_15m"),
    "completeness": oracle(f"""WITH i AS ({MODAL.replace('FROM reading)', 'FROM reading_15m)')}), b AS (SELECT site_id, count(*) AS n_rows, epoch(max(ts)) - epoch(min(ts)) AS span FROM reading_15m GROUP BY ALL)
        SELECT site_id, n_rows, round(least(100, 100.0::DOUBLE*n_rows/greatest(1, span/interval_s + 1)), 6) AS completeness_pct FROM b JOIN i USING (site_id)""", "reading_15m"),
    "merge_dedupe": oracle("""SELECT site_id, file_seq, seq, ts, fold, leq, lmax, lmin FROM reading
        QUALIFY row_number() OVER (PARTITION BY site_id, ts, fold ORDER BY file_seq, seq) = 1""", "reading"),
    "merge_notes": oracle("""WITH d AS (SELECT site_id, count(*) - count(DISTINCT ts) AS n FROM reading GROUP BY ALL)
        SELECT site_id, 'duplicate_time' AS code, n, concat('left out for a time that an earlier file or row has: ', format('{:,}', n)) AS text
        FROM d WHERE n > 0""", "reading"),
    "file_details": oracle("""SELECT site_id, file_seq, count(*) AS rows, min(ts) AS start, max(ts) AS "end" FROM reading GROUP BY ALL""", "reading"),
    "noise_events": oracle(f"WITH {EVENTS} SELECT * FROM e", "reading"),
    # greedy choice, one pick per level of the recursion
    "top_events": oracle(f"""WITH RECURSIVE {EVENTS}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY peak DESC, peak_time, event_id) AS r FROM e),
        p AS (SELECT site_id, 1 AS rank, r, [peak_time] AS got FROM o WHERE r = 1
            UNION ALL SELECT site_id, rank, r, got FROM (SELECT o.site_id, p.rank + 1 AS rank, o.r AS r, list_append(p.got, o.peak_time) AS got,
                row_number() OVER (PARTITION BY o.site_id ORDER BY o.r) AS k FROM p JOIN o ON o.site_id = p.site_id AND o.r > p.r AND p.rank < 10
                AND NOT list_bool_or(list_transform(p.got, lambda g: abs(epoch(g) - epoch(o.peak_time)) <= 300))) WHERE k = 1)
        SELECT o.site_id, event_id, start, "end", peak_time, peak, duration_s, n_readings, CAST(p.rank AS INT) AS rank FROM p JOIN o ON o.site_id = p.site_id AND o.r = p.r""".replace("WITH RECURSIVE", "WITH"), "reading").replace("WITH reading", "WITH RECURSIVE reading", 1),
}

"""Registered queries of guideline and site comparisons."""

from __future__ import annotations

from noisefleet import schema
from noisefleet.operators import compare as cmp
from noisefleet.plans.registry.common import Query, rounded
from noisefleet.plans.registry.continuity import EXCLUSIONS, STEPS
from noisefleet.plans.registry.levels import COMAR_NIGHT, LDEN, NIGHT, RATING_WINDOWS
from noisefleet.plans.registry.sqlviews import laeq, oracle
from noisefleet.plans.views import view
from pyspark.sql import functions as F


def _metrics(s, d):
    return cmp.site_metrics(view(s, d, "reading_15m"))


QUERIES: dict[str, Query] = {
    "compliance_matrix": lambda s, d: cmp.compliance_matrix(cmp.limit_inputs(view(s, d, "reading"))),
    "compliance_matrix_indoor": lambda s, d: cmp.compliance_matrix(
        cmp.limit_inputs(view(s, d, "reading")), F.when(F.col("site_id") != "view", "Indoor")),
    "guideline_by_channel": lambda s, d: rounded(cmp.guideline_by_channel(view(s, d, "reading"))),
    "compare_sites": lambda s, d: rounded(_metrics(s, d), 5),
    "rank_sites": lambda s, d: cmp.rank_sites(_metrics(s, d)),
    "comparison_summary": lambda s, d: cmp.comparison_summary(_metrics(s, d)),
}

INPUTS = f"""g AS (SELECT site_id, {RATING_WINDOWS}, max(lmax) FILTER (WHERE {NIGHT}) AS lamax_night FROM reading GROUP BY ALL),
    m AS (SELECT *, laeq_night_lden AS lnight, {LDEN} AS lden FROM g)"""
LIMITS = "lim AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("'" + v + "'" if isinstance(v, str) else (f"{v}::DOUBLE" if isinstance(v, float) else str(v)) for v in r) + ")" for r in schema.LIMITS
) + ") t(" + ", ".join(schema.LIMIT_COLUMNS) + "))"


def matrix(indoor: str) -> str:
    return f"""WITH {INPUTS}, {LIMITS}, l AS (SELECT site_id, metric_key, measured FROM m UNPIVOT (measured FOR metric_key IN (lden, lnight, lamax_night, laeq_day_ldn, laeq_night_ldn)))
        SELECT site_id, CAST(row AS INT) AS row, standard, metric, round_even(measured,1) AS measured_db, limit_db,
        CASE WHEN measured > limit_db THEN 'ABOVE' ELSE 'AT OR BELOW' END AS status, CASE WHEN source_specific OR indicative_only THEN 'indicative' ELSE 'comparison' END AS kind,
        source_specific, round_even(measured - limit_db,1) AS delta_db, source, category FROM l JOIN lim USING (metric_key) WHERE NOT indoor_only OR {indoor}"""


METRICS = f"""{EXCLUSIONS}, {STEPS}, b AS (SELECT site_id, count(*) AS n_records, {laeq()} AS laeq, max(lmax) AS lmax, min(lmin) AS lmin, {RATING_WINDOWS},
        quantile_cont(leq,0.9) AS l10, quantile_cont(leq,0.5) AS l50, quantile_cont(leq,0.1) AS l90, quantile_cont(leq,0.25) AS q1, quantile_cont(leq,0.75) AS q3,
        100*avg(CASE WHEN leq > 53 THEN 1.0::DOUBLE ELSE 0 END) AS pct_above_53, 100*avg(CASE WHEN leq > 45 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE {COMAR_NIGHT}) AS pct_night_above_45,
        min(ts) AS start, max(ts) AS "end", epoch(max(ts)) - epoch(min(ts)) AS span FROM reading_15m GROUP BY ALL),
    w AS (SELECT site_id, min(leq) AS box_lo, max(leq) AS box_hi FROM reading_15m JOIN b USING (site_id) WHERE leq BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) GROUP BY ALL),
    gg AS (SELECT site_id, count(*) AS n_gaps, sum(step - interval_s) AS missing, count(*) FILTER (WHERE interval_s >= 3600) AS cc FROM g0 GROUP BY ALL),
    metrics AS (SELECT site_id, n_records, laeq, b.lmax, b.lmin, {LDEN} AS lden, laeq_night_lden AS lnight, l10, l50, l90, pct_above_53, pct_night_above_45, q1, l50 AS median, q3,
        box_lo, box_hi, floor(least(100, n_records::DOUBLE/greatest(CAST(round_even(span/interval_s,0) AS BIGINT) + 1, n_records)*100)*100)/100 AS completeness_pct,
        coalesce(n_gaps, 0) AS n_gaps, coalesce(missing, 0)::DOUBLE AS missing_seconds, coalesce(cc, 0) AS n_clock_changes, start, "end", span/604800 AS n_weeks,
        concat_ws(', ', CASE WHEN span >= 86400 THEN concat(CAST(floor(span/86400) AS INT), ' day', CASE WHEN span >= 172800 THEN 's' ELSE '' END) END,
            CASE WHEN span % 86400 >= 3600 THEN concat(CAST(floor(span % 86400/3600) AS INT), ' hr', CASE WHEN floor(span % 86400/3600) = 1 THEN '' ELSE 's' END) END,
            CASE WHEN span % 3600 >= 60 AND span < 30*86400 THEN concat(CAST(floor(span % 3600/60) AS INT), ' min') END) AS duration_label
        FROM b JOIN i USING (site_id) LEFT JOIN w USING (site_id) LEFT JOIN gg USING (site_id))"""
METRIC_DOUBLES = ["laeq", "lmax", "lmin", "lden", "lnight", "l10", "l50", "l90", "pct_above_53", "pct_night_above_45", "q1", "median", "q3", "box_lo", "box_hi",
                  "completeness_pct", "missing_seconds", "n_weeks"]

ORACLES = {
    "compliance_matrix": oracle(matrix("false"), "reading"),
    "compliance_matrix_indoor": oracle(matrix("site_id <> 'view'"), "reading"),
    "guideline_by_channel": oracle(f"""WITH {INPUTS}, l AS (
        SELECT site_id, 'leq' AS channel, 'WHO 2018 Transport (road traffic reference) — Lden' AS comparison, 'Lden' AS metric, 53.0::DOUBLE AS limit_db, lden AS v, 'strong' AS recommendation_strength FROM m
        UNION ALL SELECT site_id, 'leq', 'WHO 2018 Transport (road traffic reference) — Lnight', 'Lnight', 45, lnight, 'strong' FROM m
        UNION ALL SELECT site_id, 'leq', 'WHO 2018 Leisure — LAeq,24h', 'LAeq_24h', 70, laeq_24h, 'conditional' FROM m
        UNION ALL SELECT site_id, 'lmax', 'Sleep disturbance (facade) — LAmax night', 'LAmax_night', 60, lamax_night, 'contextual' FROM m WHERE lamax_night IS NOT NULL)
        SELECT site_id, channel, comparison, metric, limit_db, round(v,4) AS value_db, recommendation_strength,
        CASE WHEN v IS NULL THEN 'N/A' WHEN v <= limit_db THEN 'AT OR BELOW' ELSE 'ABOVE' END AS status, round(greatest(0, v - limit_db),4) AS exceeded_by_db FROM l""", "reading"),
    "compare_sites": oracle(f"WITH {METRICS} SELECT * REPLACE (" + ", ".join(f"round({c},5) AS {c}" for c in METRIC_DOUBLES) + ") FROM metrics", "reading_15m"),
    "rank_sites": oracle(f"""WITH {METRICS}, f AS (SELECT bool_and(lden IS NOT NULL) AS ok FROM metrics),
        v AS (SELECT site_id, CASE WHEN ok THEN round(lden,2) ELSE round(laeq,2) END AS level, CASE WHEN ok THEN 'Lden' ELSE 'LAeq' END AS ranked_by FROM metrics, f)
        SELECT site_id, rank() OVER (ORDER BY level) AS rank, level, ranked_by FROM v WHERE level IS NOT NULL""", "reading_15m"),
    "comparison_summary": oracle(f"""WITH {METRICS}, v AS (SELECT site_id, round(lden,2) AS lden, round(lnight,2) AS lnight, completeness_pct FROM metrics)
        SELECT count(*) AS n_total, 'Lden' AS ranked_by, arg_min(site_id, lden) AS quietest, round_even(min(lden),1) AS quietest_level, arg_max(site_id, lden) AS loudest,
        round_even(max(lden),1) AS loudest_level, round_even(max(lden) - min(lden),1) AS gap_db, count(*) FILTER (WHERE lden > 53) AS n_exceed_day,
        count(*) FILTER (WHERE lnight > 45) AS n_exceed_night, count(*) FILTER (WHERE completeness_pct < 90) AS n_incomplete FROM v""", "reading_15m"),
}

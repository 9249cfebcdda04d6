"""Registered queries of the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisefleet.functions import text
from noisefleet.operators import filters as flt
from noisefleet.plans.registry.common import Query, rounded
from noisefleet.plans.registry.continuity import EXCLUSIONS
from noisefleet.plans.registry.sqlviews import oracle
from noisefleet.plans.views import exclusions, table, view
from noisefleet.sources import sinks


def _marked(s, d):
    return flt.mark_kept(view(s, d, "reading"), "2024-01-03", "2024-01-25", exclusions(s, d))


def _labels(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        "c_custkey", F.when(k % 4 == 0, F.concat(F.lit("SITE-"), k)).when(k % 4 == 1, F.col("c_name"))
        .when(k % 4 == 2, F.concat(F.lit("home "), F.substring("c_mktsegment", 1, 1))).otherwise(k.cast("string")).alias("label"))


QUERIES: dict[str, Query] = {
    "filter_bounds": lambda s, d: flt.between(view(s, d, "reading"), "2024-01-05", "2024-01-20"),
    "filter_exclusions": lambda s, d: flt.drop_excluded(view(s, d, "reading"), exclusions(s, d)),
    "filter_report": lambda s, d: rounded(flt.filter_report(_marked(s, d))),
    "removed_windows": lambda s, d: flt.removed_windows(_marked(s, d)),
    "preview": lambda s, d: flt.preview(view(s, d, "reading")),
    "deidentify": lambda s, d: _labels(s, d).select(
        "c_custkey", "label", text.safe_label(F.col("label"), F.concat(F.lit("Location "), F.col("c_custkey"))).alias("shown"),
        (~text.is_safe_label(F.col("label"))).alias("redacted")),
    "finite_levels": lambda s, d: sinks.finite_doubles(view(s, d, "reading").withColumn(
        "leq", F.when(F.col("seq") % 7 == 0, F.lit(float("nan"))).when(F.col("seq") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("leq")))),
}

KEPT = f"""{EXCLUSIONS}, m AS (SELECT r.*, ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-26'
    AND NOT coalesce(ts >= x.start AND ts <= x."end", false) AS kept FROM reading r LEFT JOIN x USING (site_id))"""

ORACLES = {
    "filter_bounds": oracle("SELECT * FROM reading WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'", "reading"),
    "filter_exclusions": oracle(f"""WITH {EXCLUSIONS} SELECT r.* FROM reading r WHERE NOT EXISTS
        (SELECT 1 FROM x WHERE x.site_id = r.site_id AND r.ts BETWEEN x.start AND x."end")""", "reading"),
    "filter_report": oracle(f"""WITH {KEPT} SELECT site_id, count(*) AS total_rows, count_if(kept)::BIGINT AS retained_rows,
        (count(*) - count_if(kept))::BIGINT AS dropped_rows, CAST(0 AS BIGINT) AS unreadable_rows, round(100.0::DOUBLE*count_if(kept)/count(*),4) AS retained_pct,
        min(ts) AS record_start, max(ts) AS record_end FROM m GROUP BY ALL""", "reading"),
    "removed_windows": oracle(f"""WITH {KEPT}, a AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY seq) AS i FROM m),
        b AS (SELECT *, i - row_number() OVER (PARTITION BY site_id ORDER BY seq) AS grp FROM a WHERE NOT kept)
        SELECT site_id, arg_min(ts, seq) AS start, arg_max(ts, seq) AS "end", count(*) AS n_removed FROM b GROUP BY site_id, grp""", "reading"),
    "preview": oracle("""SELECT site_id, file_seq, seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round_even(leq,1) AS leq, round_even(lmax,1) AS lmax,
        round_even(lmin,1) AS lmin FROM reading ORDER BY site_id, seq LIMIT 10""", "reading"),
    "deidentify": oracle(r"""WITH l AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('SITE-', c_custkey) WHEN 1 THEN c_name
        WHEN 2 THEN concat('home ', c_mktsegment[1:1]) ELSE c_custkey::VARCHAR END AS label FROM customer),
        m AS (SELECT *, regexp_matches(label, '^(?:(?:home|house)\s*[A-Z]|(?:conv|pair|site|loc|dev|unit)\s*[-_]?\d{1,4}|[A-Z]{1,6}[-_]?\d{1,6}|\d{1,6})$', 'i') AS ok FROM l)
        SELECT c_custkey, label, CASE WHEN ok THEN label ELSE concat('Location ', c_custkey) END AS shown, NOT ok AS redacted FROM m"""),
    "finite_levels": oracle("SELECT * REPLACE (CASE WHEN seq % 7 = 0 OR seq % 11 = 0 THEN NULL ELSE leq END AS leq) FROM reading", "reading"),
}

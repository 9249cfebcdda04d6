"""Comparison with guideline limits, and of sites with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisefleet import schema
from noisefleet.functions import clock as ck
from noisefleet.functions import levels as lv
from noisefleet.functions import text
from noisefleet.operators import aggregates as agg
from noisefleet.operators import continuity, ranks
from noisefleet.operators.scans import SITE
from noisefleet.session import cut_lineage

# Fixed values.
WHO_LDEN_DB, WHO_LNIGHT_DB, FACADE_LAMAX_DB = 53.0, 45.0, 60.0
INCOMPLETE_PCT = 90.0
TIME_DEPENDENT = ("lden", "ldn", "lnight", "laeq_day_ldn", "laeq_night_ldn", "laeq_day_lden", "laeq_evening_lden", "laeq_night_lden")


def limit_inputs(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Rating levels and night L-Max per site, from one pass over the readings."""
    hour = F.hour("ts")
    timed = F.col("ts").isNotNull()
    level = F.when(timed, F.col("leq"))
    g = df.groupBy(*keys).agg(
        *[c.alias(n) for n, c in agg.rating_columns(hour, level).items()],
        F.max(F.when(lv.in_hours(hour, lv.NIGHT_LDEN), F.col("lmax"))).alias("lamax_night"))
    return g.select("*", F.col("laeq_night_lden").alias("lnight"), lv.ldn(F.col("laeq_day_ldn"), F.col("laeq_night_ldn")).alias("ldn"),
                    lv.lden(F.col("laeq_day_lden"), F.col("laeq_evening_lden"), F.col("laeq_night_lden")).alias("lden"))


def _half_even(c: Column, digits: int) -> Column:
    scale = F.lit(float(10 ** digits))
    return F.rint(c * scale) / scale


def compliance_matrix(levels: DataFrame, environment: Column | None = None, keys: Sequence[str] = SITE) -> DataFrame:
    """Each site against the limit rows that apply: a missing level or an outdoor microphone drops a row.

    The matrix has ten fixed rows, unfolded from each site's row instead of joined to it.
    """
    env = F.lit("outdoor") if environment is None else F.lower(F.trim(F.coalesce(environment, F.lit("outdoor"))))
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(schema.LIMIT_COLUMNS, r)], F.col(r[3]).alias("measured")) for r in schema.LIMITS]
    j = levels.select(*keys, env.alias("_env"), F.explode(F.array(*rows)).alias("r")).select(*keys, "_env", "r.*").where(
        F.col("measured").isNotNull() & (~F.col("indoor_only") | (F.col("_env") == "indoor")))
    return j.select(
        *keys, "row", "standard", "metric", _half_even(F.col("measured"), 1).alias("measured_db"), "limit_db",
        F.when(F.col("measured") > F.col("limit_db"), "ABOVE").otherwise("AT OR BELOW").alias("status"),
        F.when(F.col("source_specific") | F.col("indicative_only"), "indicative").otherwise("comparison").alias("kind"),
        "source_specific", _half_even(F.col("measured") - F.col("limit_db"), 1).alias("delta_db"), "source", "category")


def guideline_by_channel(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Channel levels against road traffic, leisure and facade values; N/A where a level is missing."""
    m = limit_inputs(df, keys)
    # What is compared for which channel.
    rows = [("leq", "WHO 2018 Transport (road traffic reference) — Lden", "Lden", "lden", "road_traffic"),
            ("leq", "WHO 2018 Transport (road traffic reference) — Lnight", "Lnight", "lnight", "road_traffic"),
            ("leq", "WHO 2018 Leisure — LAeq,24h", "LAeq_24h", "laeq_24h", "leisure")]
    limit = {(s, q): (v, w) for s, q, v, w in schema.GUIDELINES}
    entries = [F.struct(F.lit(ch).alias("channel"), F.lit(label).alias("comparison"), F.lit(q).alias("metric"),
                        F.lit(limit[(src, q)][0]).alias("limit_db"), F.col(c).alias("value_db"),
                        F.lit(limit[(src, q)][1]).alias("recommendation_strength")) for ch, label, q, c, src in rows]
    night = F.when(F.col("lamax_night").isNotNull(), F.struct(
        F.lit("lmax").alias("channel"), F.lit("Sleep disturbance (facade) — LAmax night").alias("comparison"), F.lit("LAmax_night").alias("metric"),
        F.lit(FACADE_LAMAX_DB).alias("limit_db"), F.col("lamax_night").alias("value_db"), F.lit("contextual").alias("recommendation_strength")))
    long = m.select(*keys, F.explode(F.array_compact(F.array(*entries, night))).alias("g")).select(*keys, "g.*")
    v, lim = F.col("value_db"), F.col("limit_db")
    status = F.when(v.isNull(), "N/A").when(v <= lim, "AT OR BELOW").otherwise("ABOVE")
    return long.withColumn("status", status).withColumn("exceeded_by_db", F.when(v.isNotNull(), F.greatest(F.lit(0.0), v - lim)))


def site_metrics(df: DataFrame, zone: str = ck.DEFAULT_ZONE, keys: Sequence[str] = SITE) -> DataFrame:
    """Everything a site comparison shows, one row per site."""
    k = list(keys)
    hour = F.hour("ts")
    level = F.col("leq")
    timed_level = F.when(F.col("ts").isNotNull(), level)
    ratings = {n: c for n, c in agg.rating_columns(hour, timed_level).items() if n.endswith("_lden")}
    base = df.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_records"), lv.laeq(level).alias("laeq"), F.coalesce(F.max("lmax"), F.max(level)).alias("lmax"),
        F.coalesce(F.min("lmin"), F.min(level)).alias("lmin"), *[c.alias(n) for n, c in ratings.items()],
        lv.pct_above(level, WHO_LDEN_DB).alias("pct_above_53"),
        lv.pct_above(timed_level, WHO_LNIGHT_DB, lv.in_hours(hour, lv.NIGHT_LDN)).alias("pct_night_above_45"),
        F.min("ts").alias("start"), F.max("ts").alias("end"))
    r = ranks.ranked(ranks.kept_counts(df, k), k)
    shape = r.groupBy(*k).agg(*[ranks.percentile_of_ranked(p).alias(n) for n, p in (
        ("l10", 0.9), ("l50", 0.5), ("l90", 0.1), ("q1", 0.25), ("q3", 0.75))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    whiskers = r.join(shape, k).groupBy(*k).agg(F.min(F.when(inside, F.col("v"))).alias("box_lo"), F.max(F.when(inside, F.col("v"))).alias("box_hi"))
    gaps = continuity.gap_summary(df, zone, None, k).select(
        *k, F.col("uptime_pct").alias("completeness_pct"), F.col("gap_count").alias("n_gaps"), "missing_seconds", "n_clock_changes")
    span = ck.seconds_between("start", "end")
    return base.join(shape, k, "left").join(whiskers, k, "left").join(gaps, k, "left").select(
        *k, "n_records", "laeq", "lmax", "lmin",
        lv.lden(F.col("laeq_day_lden"), F.col("laeq_evening_lden"), F.col("laeq_night_lden")).alias("lden"),
        F.col("laeq_night_lden").alias("lnight"), "l10", "l50", "l90", "pct_above_53", "pct_night_above_45", "q1", F.col("l50").alias("median"),
        "q3", "box_lo", "box_hi", "completeness_pct", "n_gaps", "missing_seconds", "n_clock_changes", "start", "end",
        (span / 86400.0 / 7.0).alias("n_weeks"), text.duration_label(span).alias("duration_label"))


def rank_sites(metrics: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Sites ordered quietest first: by Lden if every site has one, else by LAeq.

    Ranks come from counted levels and level bins, so no task sorts all sites.
    """
    k = list(keys)
    # one row per site, read four times below
    two = cut_lineage(metrics.select(*k, F.round("lden", 2).alias("lden"), F.round("laeq", 2).alias("laeq")))
    by_lden = two.agg(F.bool_and(F.col("lden").isNotNull())).first()[0]
    level = "lden" if by_lden else "laeq"
    valued = two.where(F.col(level).isNotNull()).select(*k, F.col(level).alias("level"), F.lit("Lden" if by_lden else "LAeq").alias("ranked_by"))
    r = ranks.ranked(ranks.value_counts(valued, [], "level"), []).select(F.col("v").alias("level"), (F.col("rank0") + 1).alias("rank"))
    return valued.join(r, "level").select(*k, "rank", "level", "ranked_by")


def comparison_summary(metrics: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Quietest and loudest site, the difference, and how many exceed the guideline values. One row."""
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in keys])
    m = metrics.select(name.alias("name"), F.round("lden", 2).alias("lden"), F.round("lnight", 2).alias("lnight"),
                       F.round("laeq", 2).alias("laeq"), "completeness_pct")
    def ends(c: str) -> list[Column]:
        v = F.col(c)
        return [F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), "name"))).alias(f"_q_{c}"),
                F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), "name"))).alias(f"_l_{c}"), F.count(v).alias(f"_n_{c}")]
    g = m.agg(F.count(F.lit(1)).alias("n_total"), *ends("lden"), *ends("laeq"),
              F.count_if(F.col("lden") > WHO_LDEN_DB).alias("n_exceed_day"), F.count_if(F.col("lnight") > WHO_LNIGHT_DB).alias("n_exceed_night"),
              F.count_if(F.col("completeness_pct") < INCOMPLETE_PCT).alias("n_incomplete"))
    by_lden = (F.col("_n_lden") == F.col("n_total")) & (F.col("n_total") > 0)
    q = F.when(by_lden, F.col("_q_lden")).otherwise(F.col("_q_laeq"))
    top = F.when(by_lden, F.col("_l_lden")).otherwise(F.col("_l_laeq"))
    enough = F.when(by_lden, F.col("_n_lden")).otherwise(F.col("_n_laeq")) >= 2
    return g.select(
        "n_total", F.when(by_lden, "Lden").otherwise("LAeq").alias("ranked_by"), F.when(enough, q["name"]).alias("quietest"),
        F.when(enough, _half_even(q["v"], 1)).alias("quietest_level"), F.when(enough, top["name"]).alias("loudest"),
        F.when(enough, _half_even(top["v"], 1)).alias("loudest_level"), F.when(enough, _half_even(top["v"] - q["v"], 1)).alias("gap_db"),
        "n_exceed_day", "n_exceed_night", "n_incomplete")


def suppress_untrusted(levels: DataFrame, integrity: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Blank every level that depends on the time of day where a site's times cannot be trusted."""
    trusted = F.coalesce(F.col("time_metrics_valid"), F.lit(False))
    j = levels.join(integrity.select(*keys, "time_metrics_valid"), list(keys), "left")
    held = {c: F.when(trusted, F.col(c)) for c in TIME_DEPENDENT if c in levels.columns}
    return j.withColumns(held).withColumn("time_metrics_suppressed", ~trusted).drop("time_metrics_valid")

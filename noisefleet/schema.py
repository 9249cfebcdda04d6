"""Table schemas and the guideline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column lists as Spark reads and writes them.
READING = ("site_id string, file_seq int, seq bigint, ts timestamp_ntz, fold tinyint, leq double, lmax double, "
           "lmin double")
ONEMIN = ("station string, valid_utc timestamp_ntz, seq bigint, tmpf double, sknt double, gust_sknt double, "
          "ptype string, precip double")
METAR = ("station string, valid_utc timestamp_ntz, seq bigint, tmpf double, sknt double, gust double, "
         "wxcodes string, metar string")
SNOW_DAILY = "ghcnd_id string, date date, snwd_mm double, snow_mm double"
STATION = "station_id string, name string, lat double, lon double, tz string, has_1min boolean, ghcnd_id string"
SITE = "site_id string, lat double, lon double, tz string, environment string"
EXCLUSION = "site_id string, start timestamp_ntz, end timestamp_ntz"
NOTE = "site_id string, code string, n bigint, text string"

# The limit matrix, in its order. metric_key names the measured column.
LIMITS = [
    (1, "WHO 2018 — Road Traffic", "Lden", "lden", 53.0, "who_env", False, False, False, "WHO Environmental Noise Guidelines (2018), Table 1"),
    (2, "WHO 2018 — Road Traffic", "Lnight", "lnight", 45.0, "who_env", False, False, False, "WHO Environmental Noise Guidelines (2018), Table 1"),
    (3, "WHO 2018 — Aircraft Noise", "Lden", "lden", 45.0, "who_env", True, False, False, "WHO Environmental Noise Guidelines (2018), Table 1"),
    (4, "WHO 2018 — Aircraft Noise", "Lnight", "lnight", 40.0, "who_env", True, False, False, "WHO Environmental Noise Guidelines (2018), Table 1"),
    (5, "WHO 2018 — Railway", "Lden", "lden", 54.0, "who_env", True, False, False, "WHO Environmental Noise Guidelines (2018), Table 1"),
    (6, "WHO 2018 — Railway", "Lnight", "lnight", 44.0, "who_env", True, False, False, "WHO Environmental Noise Guidelines (2018), Table 1"),
    (7, "WHO Indoor — Bedroom (average)", "LAeq, night 23:00–07:00", "lnight", 30.0, "who_indoor", False, True, False, "WHO Guidelines for Community Noise (1999), Table 4.1"),
    (8, "WHO Indoor — Bedroom (single event)", "LAmax, night 23:00–07:00", "lamax_night", 45.0, "who_indoor", False, True, True, "WHO Guidelines for Community Noise (1999), Table 4.1"),
    (9, "MD COMAR Day (07:00-22:00)", "LAeq (07:00–22:00)", "laeq_day_ldn", 65.0, "maryland", False, False, False, "COMAR 26.02.03.02B(1), Table 1 — Maximum Allowable Noise Levels (residential)"),
    (10, "MD COMAR Night (22:00-07:00)", "LAeq (22:00–07:00)", "laeq_night_ldn", 55.0, "maryland", False, False, False, "COMAR 26.02.03.02B(1), Table 1 — Maximum Allowable Noise Levels (residential)"),
]
LIMIT_COLUMNS = ("row", "standard", "metric", "metric_key", "limit_db", "category", "source_specific", "indoor_only",
                 "indicative_only", "source")

# Guideline levels per noise source or room.
GUIDELINES = [
    ("road_traffic", "Lden", 53.0, "strong"), ("road_traffic", "Lnight", 45.0, "strong"),
    ("railway", "Lden", 54.0, "strong"), ("railway", "Lnight", 44.0, "strong"),
    ("aircraft", "Lden", 45.0, "strong"), ("aircraft", "Lnight", 40.0, "strong"),
    ("wind_turbines", "Lden", 45.0, "conditional"), ("leisure", "LAeq_24h", 70.0, "conditional"),
    ("bedroom_sleep", "LAeq", 30.0, "WHO 1999 guidance"), ("bedroom_sleep", "LAmax", 45.0, "WHO 1999 guidance"),
    ("living_room", "LAeq", 35.0, "WHO 1999 guidance"), ("classroom", "LAeq", 35.0, "WHO 1999 guidance"),
]
GUIDELINE_COLUMNS = "source_key string, metric string, limit_db double, strength string"

# Land-use limits of the state regulation, day and night.
LAND_USE_LIMITS = {"residential": (65.0, 55.0), "commercial": (67.0, 62.0), "industrial": (75.0, 75.0)}


def guidelines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GUIDELINES, GUIDELINE_COLUMNS)

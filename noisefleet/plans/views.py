"""The reading, weather and station tables the registered queries run on, derived from the test tables.

No test table holds a sound level, so levels, times and weather are projections of ``events`` and the
other tables. They keep the row counts of their sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noisefleet.session import new_folder, prepare

K = "CAST(get_json_object(props,'$.k') AS INT)"

SQL = {
    "reading": f"""SELECT event_type AS site_id, CAST(user_id % 3 AS INT) AS file_seq, event_id AS seq,
        CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) AS ts, CAST(0 AS TINYINT) AS fold, 35 + value/8 AS leq,
        35 + value/8 + ({K} % 10)/2D AS lmax, 35 + value/8 - ({K} % 7)/2D AS lmin FROM events""",
    "metar": f"""SELECT concat('ST', user_id % 2) AS station, CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) AS valid_utc, event_id AS seq,
        20 + k % 60 AS tmpf, CAST(k % 25 AS DOUBLE) AS sknt,
        CASE WHEN k % 5 = 0 THEN CAST(k % 25 + 8 AS DOUBLE) END AS gust,
        CASE k % 16 WHEN 0 THEN '-RA BR' WHEN 1 THEN '+TSRA' WHEN 2 THEN 'SN' WHEN 3 THEN 'VCTS' WHEN 4 THEN 'UP'
             WHEN 5 THEN 'BR' ELSE '' END AS wxcodes,
        CASE WHEN k % 31 = 7 THEN 'RMK AO2 PWINO' ELSE '' END AS metar
        FROM (SELECT *, {K} AS k FROM events) WHERE event_type IN ('error','view')""",
    "onemin": f"""SELECT concat('ST', user_id % 2) AS station, CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) AS valid_utc, event_id AS seq,
        20 + k % 60 AS tmpf, CASE WHEN k % 23 = 5 THEN NULL ELSE CAST(k % 20 AS DOUBLE) END AS sknt,
        CAST(k % 20 + 3 AS DOUBLE) AS gust_sknt,
        CASE k % 14 WHEN 0 THEN 'R-' WHEN 1 THEN 'S' WHEN 2 THEN 'P' WHEN 3 THEN '' WHEN 4 THEN 'M' ELSE 'NP' END AS ptype,
        CASE WHEN k % 17 = 0 THEN 0.01D ELSE 0D END AS precip
        FROM (SELECT *, {K} AS k FROM events) WHERE event_type IN ('click','purchase','signup')""",
    "snow_daily": """SELECT 'GH0' AS ghcnd_id, CAST(o_orderdate AS DATE) AS date,
        CASE WHEN count(*) % 5 = 4 THEN NULL ELSE CAST(count(*) % 4 AS DOUBLE) * 12.7D END AS snwd_mm,
        CASE WHEN count(*) % 7 = 6 THEN NULL ELSE CAST(count(*) % 2 AS DOUBLE) * 25.4D END AS snow_mm
        FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
    "station": """SELECT CAST(s_suppkey AS STRING) AS station_id, s_name AS name, 25 + (s_suppkey * 7 % 240)/10D AS lat,
        -125 + (s_suppkey * 13 % 580)/10D AS lon, s_suppkey % 3 = 0 AS has_1min FROM supplier""",
    "site": """SELECT CAST(c_custkey AS STRING) AS site_id, 25 + (c_custkey * 11 % 240)/10D AS lat,
        -125 + (c_custkey * 17 % 580)/10D AS lon FROM customer""",
    "raw_text": """SELECT event_type AS site_id, event_id AS seq,
        CASE WHEN event_id % 97 = 0 THEN 'not a time' WHEN event_type = 'click' THEN date_format(ts,'yyyy/MM/dd HH:mm:ss')
             WHEN event_type = 'view' THEN date_format(ts,'dd/MM/yyyy HH:mm:ss')
             ELSE date_format(ts,'yyyy-MM-dd HH:mm:ss') END AS raw,
        CASE WHEN event_id % 50 = 0 THEN 'n/a' ELSE replace(CAST(value AS STRING), '.', ',') END AS x FROM events""",
    # V1 in files that each number their own rows, before they are merged
    "reading_files": f"""SELECT site_id, file_seq, row_number() OVER (PARTITION BY site_id, file_seq ORDER BY seq) - 1 AS seq, ts, fold, leq, lmax, lmin
        FROM (SELECT event_type AS site_id, CAST(user_id % 3 AS INT) AS file_seq, event_id AS seq,
        CAST(ts AS TIMESTAMP_NTZ) AS ts, CAST(0 AS TINYINT) AS fold, 35 + value/8 AS leq,
        35 + value/8 + ({K} % 10)/2D AS lmax, 35 + value/8 - ({K} % 7)/2D AS lmin FROM events)""",
    # V1 on a regular 15-minute grid; seq is the bin number
    "reading_15m": f"""SELECT site_id, 0 AS file_seq, CAST(unix_seconds(CAST(ts AS TIMESTAMP)) DIV 900 AS BIGINT) AS seq, ts,
        CAST(0 AS TINYINT) AS fold, leq, lmax, lmin FROM (
        SELECT event_type AS site_id, CAST(window(ts, '15 minutes').start AS TIMESTAMP_NTZ) AS ts,
        10 * log10(avg(pow(10D, (35 + value/8)/10))) AS leq, max(35 + value/8 + ({K} % 10)/2D) AS lmax,
        min(35 + value/8 - ({K} % 7)/2D) AS lmin FROM events GROUP BY event_type, window(ts, '15 minutes'))""",
    # V1 moved to a daylight-saving month: March (+60 days) and late October (+300 days)
    "reading_march": f"""SELECT event_type AS site_id, event_id AS seq, CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) + INTERVAL 60 DAYS AS ts,
        CAST(0 AS TINYINT) AS fold, 35 + value/8 AS leq FROM events""",
    "reading_october": f"""SELECT event_type AS site_id, event_id AS seq, CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) + INTERVAL 300 DAYS AS ts,
        CAST(event_id % 2 AS TINYINT) AS fold, 35 + value/8 AS leq FROM events""",
}
# the regular grid as a New York logger shows it, across the spring and the autumn change of 2024
SQL["spring_15m"] = f"""SELECT site_id, seq, CASE WHEN u < TIMESTAMP_NTZ '2024-03-10 07:00:00' THEN u - INTERVAL 5 HOURS ELSE u - INTERVAL 4 HOURS END AS ts,
    fold, leq, lmax, lmin FROM (SELECT *, ts + INTERVAL 60 DAYS AS u FROM ({SQL['reading_15m']}))"""
SQL["autumn_15m"] = f"""SELECT site_id, seq, CASE WHEN u < TIMESTAMP_NTZ '2024-11-03 06:00:00' THEN u - INTERVAL 4 HOURS ELSE u - INTERVAL 5 HOURS END AS ts,
    fold, leq, lmax, lmin FROM (SELECT *, ts + INTERVAL 300 DAYS AS u FROM ({SQL['reading_15m']}))"""
SOURCES = {"reading_march": ["events"], "reading_october": ["events"], "spring_15m": ["events"], "autumn_15m": ["events"],
           "reading": ["events"], "metar": ["events"], "onemin": ["events"], "snow_daily": ["orders"],
           "reading_files": ["events"], "station": ["supplier"], "site": ["customer"], "raw_text": ["events"], "reading_15m": ["events"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame."""
    for source in SOURCES[name]:
        table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(SQL[name])


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as Parquet in the shared folder, so that filters and columns reach its scan."""
    path = new_folder(spark, name)
    view(spark, sf_dir, name).write.parquet(path)
    return spark.read.parquet(path)


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One excluded day per site, four days after its first reading."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql("""SELECT event_type AS site_id, CAST(date_trunc('DAY', min(ts)) + INTERVAL 4 DAYS AS TIMESTAMP_NTZ) AS start,
        CAST(date_trunc('DAY', min(ts)) + INTERVAL 5 DAYS - INTERVAL 1 SECOND AS TIMESTAMP_NTZ) AS end FROM events GROUP BY event_type""")

"""The derived views of :mod:`noisefleet.plans.views` in DuckDB's dialect, for the oracle queries."""

from __future__ import annotations

K = "CAST(json_extract_string(props,'$.k') AS INT)"

VIEWS = {
    "reading": f"""SELECT event_type AS site_id, CAST(user_id % 3 AS INT) AS file_seq, event_id AS seq,
        date_trunc('minute', ts) AS ts, CAST(0 AS TINYINT) AS fold, 35 + value/8 AS leq,
        35 + value/8 + ({K} % 10)/2.0::DOUBLE AS lmax, 35 + value/8 - ({K} % 7)/2.0::DOUBLE AS lmin FROM events""",
    "metar": f"""SELECT concat('ST', user_id % 2) AS station, date_trunc('minute', ts) AS valid_utc, event_id AS seq, 20 + k % 60 AS tmpf,
        CAST(k % 25 AS DOUBLE) AS sknt, CASE WHEN k % 5 = 0 THEN CAST(k % 25 + 8 AS DOUBLE) END AS gust,
        CASE k % 16 WHEN 0 THEN '-RA BR' WHEN 1 THEN '+TSRA' WHEN 2 THEN 'SN' WHEN 3 THEN 'VCTS' WHEN 4 THEN 'UP'
             WHEN 5 THEN 'BR' ELSE '' END AS wxcodes,
        CASE WHEN k % 31 = 7 THEN 'RMK AO2 PWINO' ELSE '' END AS metar
        FROM (SELECT *, {K} AS k FROM events) WHERE event_type IN ('error','view')""",
    "onemin": f"""SELECT concat('ST', user_id % 2) AS station, date_trunc('minute', ts) AS valid_utc, event_id AS seq, 20 + k % 60 AS tmpf,
        CASE WHEN k % 23 = 5 THEN NULL ELSE CAST(k % 20 AS DOUBLE) END AS sknt,
        CAST(k % 20 + 3 AS DOUBLE) AS gust_sknt,
        CASE k % 14 WHEN 0 THEN 'R-' WHEN 1 THEN 'S' WHEN 2 THEN 'P' WHEN 3 THEN '' WHEN 4 THEN 'M' ELSE 'NP' END AS ptype,
        CASE WHEN k % 17 = 0 THEN 0.01::DOUBLE ELSE 0::DOUBLE END AS precip
        FROM (SELECT *, {K} AS k FROM events) WHERE event_type IN ('click','purchase','signup')""",
    "snow_daily": """SELECT 'GH0' AS ghcnd_id, CAST(o_orderdate AS DATE) AS date,
        CASE WHEN count(*) % 5 = 4 THEN NULL ELSE CAST(count(*) % 4 AS DOUBLE) * 12.7::DOUBLE END AS snwd_mm,
        CASE WHEN count(*) % 7 = 6 THEN NULL ELSE CAST(count(*) % 2 AS DOUBLE) * 25.4::DOUBLE END AS snow_mm
        FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
    "station": """SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS name,
        25 + (s_suppkey * 7 % 240)/10.0::DOUBLE AS lat, -125 + (s_suppkey * 13 % 580)/10.0::DOUBLE AS lon,
        s_suppkey % 3 = 0 AS has_1min FROM supplier""",
    "site": """SELECT CAST(c_custkey AS VARCHAR) AS site_id, 25 + (c_custkey * 11 % 240)/10.0::DOUBLE AS lat,
        -125 + (c_custkey * 17 % 580)/10.0::DOUBLE AS lon FROM customer""",
    "raw_text": """SELECT event_type AS site_id, event_id AS seq,
        CASE WHEN event_id % 97 = 0 THEN 'not a time' WHEN event_type = 'click' THEN strftime(ts,'%Y/%m/%d %H:%M:%S')
             WHEN event_type = 'view' THEN strftime(ts,'%d/%m/%Y %H:%M:%S')
             ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END AS raw,
        CASE WHEN event_id % 50 = 0 THEN 'n/a' ELSE replace(CAST(value AS VARCHAR), '.', ',') END AS x FROM events""",
    "reading_merged": f"""SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY ts) - 1 AS seq, ts, leq, lmax, lmin
        FROM (SELECT event_type AS site_id, ts, 35 + value/8 AS leq, 35 + value/8 + ({K} % 10)/2.0::DOUBLE AS lmax,
        35 + value/8 - ({K} % 7)/2.0::DOUBLE AS lmin FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY user_id % 3, event_id) = 1)""",
    "reading_15m": f"""SELECT site_id, 0 AS file_seq, CAST(epoch(ts) AS BIGINT) // 900 AS seq, ts, CAST(0 AS TINYINT) AS fold,
        leq, lmax, lmin FROM (SELECT event_type AS site_id, time_bucket(INTERVAL '15 minutes', ts) AS ts,
        10 * log10(avg(pow(10::DOUBLE, (35 + value/8)/10))) AS leq, max(35 + value/8 + ({K} % 10)/2.0::DOUBLE) AS lmax,
        min(35 + value/8 - ({K} % 7)/2.0::DOUBLE) AS lmin FROM events GROUP BY ALL)""",
    "reading_march": """SELECT event_type AS site_id, event_id AS seq, date_trunc('minute', ts) + INTERVAL 60 DAY AS ts,
        CAST(0 AS TINYINT) AS fold, 35 + value/8 AS leq FROM events""",
    "reading_october": """SELECT event_type AS site_id, event_id AS seq, date_trunc('minute', ts) + INTERVAL 300 DAY AS ts,
        CAST(event_id % 2 AS TINYINT) AS fold, 35 + value/8 AS leq FROM events""",
    "spring_15m": """SELECT site_id, seq, CASE WHEN u < TIMESTAMP '2024-03-10 07:00:00' THEN u - INTERVAL 5 HOUR ELSE u - INTERVAL 4 HOUR END AS ts,
        fold, leq, lmax, lmin FROM (SELECT *, ts + INTERVAL 60 DAY AS u FROM reading_15m)""",
    "autumn_15m": """SELECT site_id, seq, CASE WHEN u < TIMESTAMP '2024-11-03 06:00:00' THEN u - INTERVAL 4 HOUR ELSE u - INTERVAL 5 HOUR END AS ts,
        fold, leq, lmax, lmin FROM (SELECT *, ts + INTERVAL 300 DAY AS u FROM reading_15m)""",
    "channels": """SELECT site_id, file_seq, seq, ts, channel, level FROM reading
        UNPIVOT (level FOR channel IN (leq, lmax, lmin))""",
}
NEEDS = {"channels": ["reading"], "spring_15m": ["reading_15m"], "autumn_15m": ["reading_15m"]}


def oracle(body: str, *views: str, dates: tuple[str, ...] = ()) -> str:
    """``body`` with the named views as leading common table expressions, and dates as text."""
    if dates:
        cast = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
        return f"SELECT * REPLACE ({cast}) FROM ({oracle(body, *views)})"
    names: list[str] = []
    for v in views:
        for n in (*NEEDS.get(v, []), v):
            if n not in names:
                names.append(n)
    if not names:
        return body.strip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def db(total: str, n: str) -> str:
    return f"10 * log10({total} / {n})"


def laeq(level: str = "leq", where: str | None = None) -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return f"10 * log10(avg(pow(10::DOUBLE, {level} / 10)){f})"

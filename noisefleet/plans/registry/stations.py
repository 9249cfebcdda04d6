"""Registered queries of stations and locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisefleet.functions import weather as wf
from noisefleet.operators import stations as st
from noisefleet.plans.registry.common import Query, rounded
from noisefleet.plans.registry.sqlviews import oracle
from noisefleet.plans.views import table, view


def _inventory(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").join(view(s, d, "station"), F.col("station_id") == k.cast("string")).select(
        F.concat(F.lit("US"), k).alias("ghcnd_id"), "lat", "lon", (1990 + k % 20).alias("first_year"), (2000 + k % 30).alias("last_year"))


def _history(s, d):
    k = F.col("station_id").cast("long")
    prefix = F.when(k % 3 == 0, "").when(k % 3 == 1, "K").otherwise("P")
    return view(s, d, "station").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat(prefix, "station_id").alias("icao"), F.when((k + F.col("copy")) % 17 == 0, "99999").otherwise(
            F.lpad((k * 2 + F.col("copy")).cast("string"), 5, "0")).alias("wban"),
        (F.col("lat") + (k + F.col("copy")) % 5 * 0.02).alias("lat"), "lon", (20200101 + (k * 7 + F.col("copy") * 31) % 900).alias("end"))


def _snow_source(s, d):
    o = table(s, d, "orders").select(F.concat(F.lit("G"), F.col("o_custkey") % 7).alias("ghcnd_id"), F.to_date("o_orderdate").alias("date"))
    daily = o.groupBy("ghcnd_id", "date").agg(F.count(F.lit(1)).alias("c")).select(
        "ghcnd_id", "date", F.when(F.col("c") % 3 != 0, F.col("c") * 12.7).alias("snwd_mm"))
    k = F.col("c_custkey")
    cand = table(s, d, "customer").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(6)))).select(
        k.cast("string").alias("site_id"), F.concat(F.lit("G"), (k + F.col("j")) % 7).alias("ghcnd_id"),
        ((k * 7 + F.col("j") * 13) % 120).cast("double").alias("distance_km"))
    period = table(s, d, "customer").select(k.cast("string").alias("site_id"), F.lit("1996-01-01").cast("date").alias("first_date"),
                                            F.date_add(F.lit("1996-01-01").cast("date"), (k % 300).cast("int")).alias("last_date"))
    return st.choose_snow_source(cand, daily, period)


def _places(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k.cast("string").alias("site_id"),
        F.when(k % 5 == 0, F.concat(F.format_string("%.2f", 25 + k % 40 * 0.5), F.lit(", "), F.format_string("%.2f", -120.0 + k % 50)))
        .when(k % 5 == 1, F.lpad((k % 400).cast("string"), 5, "0")).when(k % 5 == 2, F.concat(F.lpad((k % 90).cast("string"), 5, "0"), F.lit("-1234")))
        .when(k % 5 == 3, F.concat(F.lit("9"), (k % 10).cast("string"), F.lit(", 12"))).otherwise(F.col("c_name")).alias("location"))


def _centroids(s, d):
    return view(s, d, "station").select(F.lpad("station_id", 5, "0").alias("zip"), "lat", "lon")


QUERIES: dict[str, Query] = {
    "haversine": lambda s, d: rounded(view(s, d, "site").select(
        "site_id", wf.haversine_km(F.col("lat"), F.col("lon"), F.lit(39.2), F.lit(-76.7)).alias("distance_km"))),
    "nearest_stations": lambda s, d: st.nearest_stations(view(s, d, "site"), view(s, d, "station")),
    "nearest_snow": lambda s, d: rounded(st.nearest_snow_stations(view(s, d, "site"), _inventory(s, d), 2005)),
    "station_match": lambda s, d: st.match_climate_id(view(s, d, "station"), _history(s, d)),
    "snow_source": lambda s, d: rounded(_snow_source(s, d)),
    "locate_sites": lambda s, d: rounded(st.locate(_places(s, d), _centroids(s, d))),
}


def km(a: str, b: str, c: str, d: str) -> str:
    return (f"2*6371.0088::DOUBLE*asin(sqrt(pow(sin(radians({c}-{a})/2),2) + cos(radians({a}))*cos(radians({c}))"
            f"*pow(sin(radians({d}-{b})/2),2)))")


ORACLES = {
    "haversine": oracle(f"SELECT site_id, round({km('lat', 'lon', '39.2::DOUBLE', '-76.7::DOUBLE')},4) AS distance_km FROM site", "site"),
    "nearest_stations": oracle(f"""WITH p AS (SELECT DISTINCT lat, lon FROM site),
        a AS (SELECT p.lat, p.lon, s.station_id, s.name, s.has_1min, round_even({km('p.lat', 'p.lon', 's.lat', 's.lon')},1) AS distance_km FROM p CROSS JOIN station s),
        b AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY distance_km, station_id) AS rank,
              row_number() OVER (PARTITION BY lat, lon, has_1min ORDER BY distance_km, station_id) AS r1 FROM a),
        c AS (SELECT * FROM b WHERE rank <= 3 UNION ALL SELECT * REPLACE (4 AS rank) FROM b WHERE has_1min AND r1 = 1 AND rank > 3)
        SELECT site_id, CAST(rank AS INT) AS rank, station_id, name, distance_km, has_1min FROM site JOIN c USING (lat, lon)""", "site", "station"),
    "nearest_snow": oracle(f"""WITH inv AS (SELECT concat('US', s_suppkey) AS ghcnd_id, lat AS slat, lon AS slon FROM supplier JOIN station ON station_id = s_suppkey::VARCHAR
            WHERE 1990 + s_suppkey % 20 <= 2005 AND 2000 + s_suppkey % 30 >= 2005), p AS (SELECT DISTINCT lat, lon FROM site),
        a AS (SELECT lat, lon, ghcnd_id, {km('lat', 'lon', 'slat', 'slon')} AS km FROM p JOIN inv ON slat BETWEEN lat - 100/111.0::DOUBLE AND lat + 100/111.0::DOUBLE
            AND slon BETWEEN lon - (100/111.0::DOUBLE)/cos(radians(lat)) AND lon + (100/111.0::DOUBLE)/cos(radians(lat))),
        b AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY km, ghcnd_id) AS rank FROM a WHERE km <= 100)
        SELECT site_id, CAST(rank AS INT) AS rank, ghcnd_id, round(km,4) AS distance_km FROM site JOIN b USING (lat, lon) WHERE rank <= 5""", "site", "station"),
    "station_match": oracle(f"""WITH h AS (SELECT concat(CASE station_id::BIGINT % 3 WHEN 0 THEN '' WHEN 1 THEN 'K' ELSE 'P' END, station_id) AS icao,
            CASE WHEN (station_id::BIGINT + c) % 17 = 0 THEN '99999' ELSE lpad((station_id::BIGINT*2 + c)::VARCHAR, 5, '0') END AS wban,
            lat + (station_id::BIGINT + c) % 5 * 0.02::DOUBLE AS hlat, lon AS hlon, 20200101 + (station_id::BIGINT*7 + c*31) % 900 AS e
            FROM station CROSS JOIN (SELECT unnest([0, 1]) AS c)),
        m AS (SELECT s.station_id, arg_max(wban, struct_pack(e := e, w := wban)) AS w FROM station s JOIN h ON icao IN (s.station_id, concat('K', s.station_id), concat('P', s.station_id))
            WHERE wban <> '99999' AND {km('s.lat', 's.lon', 'hlat', 'hlon')} <= 5 GROUP BY ALL)
        SELECT station_id, CASE WHEN w IS NOT NULL THEN concat('USW000', w) END AS ghcnd_id FROM station LEFT JOIN m USING (station_id)""", "station"),
    "snow_source": oracle("""WITH daily AS (SELECT concat('G', o_custkey % 7) AS g, CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY ALL HAVING count(*) % 3 <> 0),
        cand AS (SELECT c_custkey::VARCHAR AS site_id, concat('G', (c_custkey + j) % 7) AS g, CAST((c_custkey*7 + j*13) % 120 AS DOUBLE) AS km, DATE '1996-01-01' AS a,
            DATE '1996-01-01' + CAST(c_custkey % 300 AS INT) AS b FROM customer CROSS JOIN (SELECT unnest(range(7)) AS j)),
        r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY km, g) AS rank FROM cand WHERE km <= 100),
        c AS (SELECT site_id, r.g, km, rank, count(*)::DOUBLE/(any_value(b) - any_value(a) + 1) AS cov FROM r JOIN daily ON daily.g = r.g AND date BETWEEN a AND b GROUP BY ALL)
        SELECT site_id, g AS ghcnd_id, round(km,4) AS distance_km, round(100*cov,4) AS coverage_pct FROM c
        QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN cov >= 0.9 THEN 0 ELSE 1 END, CASE WHEN cov >= 0.9 THEN rank END, cov DESC, rank) = 1"""),
    "locate_sites": oracle(r"""WITH p AS (SELECT c_custkey::VARCHAR AS site_id, CASE c_custkey % 5 WHEN 0 THEN concat(printf('%.2f', 25 + c_custkey % 40 * 0.5::DOUBLE), ', ', printf('%.2f', -120.0::DOUBLE + c_custkey % 50))
            WHEN 1 THEN lpad((c_custkey % 400)::VARCHAR, 5, '0') WHEN 2 THEN concat(lpad((c_custkey % 90)::VARCHAR, 5, '0'), '-1234') WHEN 3 THEN concat('9', c_custkey % 10, ', 12') ELSE c_name END AS location FROM customer),
        q AS (SELECT *, regexp_extract(location, '^(-?\d+(?:\.\d+)?), (-?\d+(?:\.\d+)?)$', ['a', 'b']) AS ll, regexp_extract(location, '^(\d{5})(?:-\d{4})?$', 1) AS z FROM p),
        c AS (SELECT lpad(station_id, 5, '0') AS z, lat AS zlat, lon AS zlon FROM station),
        x AS (SELECT q.*, TRY_CAST(ll.a AS DOUBLE) AS a, TRY_CAST(ll.b AS DOUBLE) AS b, zlat, zlon FROM q LEFT JOIN c USING (z))
        SELECT site_id, location, round(CASE WHEN a BETWEEN -90 AND 90 THEN a ELSE zlat END,4) AS lat, round(CASE WHEN a BETWEEN -90 AND 90 THEN b ELSE zlon END,4) AS lon,
        CASE WHEN a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180 THEN 'coordinates' WHEN a IS NOT NULL THEN 'outside the globe' WHEN zlat IS NOT NULL THEN 'ZIP code centroid'
        WHEN z <> '' THEN 'unknown ZIP code' ELSE 'not a location' END AS basis FROM x""", "station"),
}

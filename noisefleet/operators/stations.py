"""Nearest stations, snow stations, climate ids and site locations.

Distances are never taken over all pairs. Stations and sites meet on cells of a grid of 360/2^k
degrees, at a level chosen per location from how many stations lie around it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.functions import weather as wx
from noisefleet.operators.scans import top_rows
from noisefleet.session import cut_lineage

LEVELS = tuple(range(0, 14))      # 360 degrees down to about 5 km
KM_PER_DEGREE = wx.EARTH_RADIUS_KM * 3.141592653589793 / 180.0
# Fixed values.
SNOW_RADIUS_KM, SNOW_KM_PER_DEGREE, SNOW_STATIONS = 100.0, 111.0, 5
MATCH_KM, NO_WBAN = 5.0, "99999"
SNOW_MIN_COVERAGE = 0.9


def _size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _cell(level: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    s = _size(level)
    return F.floor((lat + 90.0) / s), F.floor((lon + 180.0) / s)


def _wrap(level: Column, cx: Column) -> Column:
    return F.pmod(cx, F.pow(F.lit(2.0), level).cast("long"))


def _around(level: Column, lat: Column, lon: Column, reach: Column, reach_lon: Column) -> Column:
    """Distinct cells within ``reach`` rows and ``reach_lon`` columns, wrapped at the date line."""
    cy, cx = _cell(level, lat, lon)
    half = F.floor(F.pow(F.lit(2.0), level) / 2).cast("long")
    across = F.array_distinct(F.transform(F.sequence(cx - F.least(reach_lon, half), cx + F.least(reach_lon, half)),
                                          lambda x: _wrap(level, x)))
    up = F.sequence(cy - reach, cy + reach)
    return F.flatten(F.transform(up, lambda y: F.transform(across, lambda x: F.struct(y.alias("cy"), x.alias("cx")))))


def nearest(places: DataFrame, stations: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest stations of every distinct (lat, lon), by distance to 0.1 km, then station id.

    Of stations at one point only the first ``n`` can be among the nearest, so copies are cut first. A
    place searches at the finest level whose 3 x 3 cells hold ``n`` stations: these lie within two
    cells' diagonal, so every station that close is compared and no other.
    """
    st = top_rows(stations.select("station_id", F.col("lat").alias("slat"), F.col("lon").alias("slon")), ["slat", "slon"],
                  F.pmod(F.xxhash64("station_id"), F.lit(64)), [F.asc("station_id")], n).drop("rank")
    p = places.select("lat", "lon").distinct()
    lv = F.col("level")
    cy, cx = _cell(lv, F.col("slat"), F.col("slon"))
    gridded = (st.withColumn("level", F.explode(F.array(*[F.lit(k) for k in LEVELS])))
               .withColumn("cy", cy).withColumn("cx", _wrap(lv, cx)))
    counts = gridded.groupBy("level", "cy", "cx").agg(F.count(F.lit(1)).alias("_n"))
    one = F.lit(1).cast("long")
    tried = (p.withColumn("level", F.explode(F.array(*[F.lit(k) for k in LEVELS])))
             .withColumn("_c", F.explode(_around(lv, F.col("lat"), F.col("lon"), one, one)))
             .select("lat", "lon", "level", "_c.*"))
    level = (tried.join(counts, ["level", "cy", "cx"]).groupBy("lat", "lon", "level").agg(F.sum("_n").alias("_n"))
             .groupBy("lat", "lon").agg(F.coalesce(F.max(F.when(F.col("_n") >= n, lv)), F.lit(0)).alias("level")))
    # two cells' diagonal, and 0.1 km for the rounding, in rows and columns of cells at that latitude
    reach_deg = 2.0 * 1.4142135623730951 * _size(lv) + 0.1 / KM_PER_DEGREE
    shrink = F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("lat")) + reach_deg))))
    rows, cols = F.ceil(reach_deg / _size(lv)), F.ceil(F.least(F.lit(360.0), reach_deg / shrink) / _size(lv))
    search = level.withColumn("_c", F.explode(_around(lv, F.col("lat"), F.col("lon"), rows, cols))).select("lat", "lon", "level", "_c.*")
    d = F.rint(wx.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")) * 10.0) / 10.0
    pairs = search.join(gridded, ["level", "cy", "cx"]).select("lat", "lon", "station_id", d.alias("distance_km"))
    return top_rows(pairs, ["lat", "lon"], F.pmod(F.xxhash64("station_id"), F.lit(16)),
                    [F.asc("distance_km"), F.asc("station_id")], n)


def nearest_stations(sites: DataFrame, stations: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` nearest stations per site, and the nearest with 1-minute data if none of them has it."""
    info = stations.select("station_id", "name", "has_1min")
    # at most n rows per place, read twice below
    near = cut_lineage(nearest(sites, stations, n)).join(info, "station_id")
    lacking = near.groupBy("lat", "lon").agg(F.bool_or("has_1min").alias("_ok")).where(~F.col("_ok")).select("lat", "lon")
    extra = (nearest(lacking, stations.where("has_1min"), 1).withColumn("rank", F.lit(n + 1))
             .join(info, "station_id"))
    both = near.unionByName(extra)
    return sites.select("site_id", "lat", "lon").join(both, ["lat", "lon"]).select(
        "site_id", "rank", "station_id", "name", "distance_km", "has_1min")


def nearest_snow_stations(sites: DataFrame, inventory: DataFrame, year: int, n: int = SNOW_STATIONS,
                          max_km: float = SNOW_RADIUS_KM) -> DataFrame:
    """Snow-depth stations active in ``year`` within ``max_km``, the ``n`` nearest per site.

    A bounding box first, met on one-degree cells; copies of a point beyond ``n`` are cut as above.
    """
    active = inventory.where((F.col("first_year") <= year) & (F.col("last_year") >= year))
    st = top_rows(active.select("ghcnd_id", F.col("lat").alias("slat"), F.col("lon").alias("slon")), ["slat", "slon"],
                  F.pmod(F.xxhash64("ghcnd_id"), F.lit(64)), [F.asc("ghcnd_id")], n).drop("rank")
    st = st.withColumn("cy", F.floor("slat")).withColumn("cx", F.floor("slon"))
    deg = F.lit(max_km / SNOW_KM_PER_DEGREE)
    wide = deg / F.greatest(F.lit(0.01), F.cos(F.radians("lat")))
    p = (sites.select("lat", "lon").distinct()
         .withColumn("cy", F.explode(F.sequence(F.floor(F.col("lat") - deg), F.floor(F.col("lat") + deg))))
         .withColumn("cx", F.explode(F.sequence(F.floor(F.col("lon") - wide), F.floor(F.col("lon") + wide)))))
    d = wx.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    box = F.col("slat").between(F.col("lat") - deg, F.col("lat") + deg) & F.col("slon").between(F.col("lon") - wide, F.col("lon") + wide)
    pairs = p.join(st, ["cy", "cx"]).where(box).withColumn("distance_km", d).where(F.col("distance_km") <= max_km)
    top = top_rows(pairs.select("lat", "lon", "ghcnd_id", "distance_km"), ["lat", "lon"], F.pmod(F.xxhash64("ghcnd_id"), F.lit(16)),
                   [F.asc("distance_km"), F.asc("ghcnd_id")], n)
    return sites.select("site_id", "lat", "lon").join(top, ["lat", "lon"]).select("site_id", "rank", "ghcnd_id", "distance_km")


def match_climate_id(stations: DataFrame, history: DataFrame) -> DataFrame:
    """Climate id of each station: same call sign (bare, K or P), within 5 km, the latest record."""
    sid = F.col("station_id")
    s = stations.select("station_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.explode(
        F.array(sid, F.concat(F.lit("K"), sid), F.concat(F.lit("P"), sid))).alias("icao"))
    near = wx.haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= MATCH_KM
    found = s.join(history.where(F.col("wban") != NO_WBAN), "icao").where(near).groupBy("station_id").agg(
        F.max_by("wban", F.struct("end", "wban")).alias("_w"))
    return stations.select("station_id").join(found, "station_id", "left").select(
        "station_id", F.when(F.col("_w").isNotNull(), F.concat(F.lit("USW000"), F.col("_w"))).alias("ghcnd_id"))


def choose_snow_source(candidates: DataFrame, daily: DataFrame, period: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """The nearest candidate whose depth record covers 90 % of the period, else the best covered one.

    ``candidates`` hold distance and station per site, ``period`` first and last date per site. All
    within 100 km are tried.
    """
    k = list(keys)
    tried = candidates.where(F.col("distance_km") <= SNOW_RADIUS_KM).join(period, k)
    # running count of days with a depth: a period is the difference of two of its rows
    known = daily.groupBy("ghcnd_id", "date").agg(F.max(F.when(F.col("snwd_mm").isNotNull(), 1)).alias("_k"))
    span = known.groupBy("ghcnd_id").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    at = Window.partitionBy("ghcnd_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = (span.select("ghcnd_id", F.explode(F.sequence(F.date_sub("_a", 1), F.col("_b"))).alias("date"))
               .join(known, ["ghcnd_id", "date"], "left")
               .select("ghcnd_id", "date", F.sum(F.coalesce("_k", F.lit(0))).over(at).alias("_days")))
    before = F.date_sub("_a", 1)

    def clip(d: Column) -> Column:
        return F.greatest(before, F.least(F.col("_b"), d))

    asked = tried.join(span, "ghcnd_id").withColumn("_to", clip(F.col("last_date"))).withColumn("_from", clip(F.date_sub("first_date", 1)))
    counted = (asked.join(running.select("ghcnd_id", F.col("date").alias("_to"), F.col("_days").alias("_n1")), ["ghcnd_id", "_to"])
               .join(running.select("ghcnd_id", F.col("date").alias("_from"), F.col("_days").alias("_n0")), ["ghcnd_id", "_from"])
               .withColumn("_n", F.col("_n1") - F.col("_n0")).where(F.col("_n") > 0))
    length = F.greatest(F.lit(1), F.date_diff("last_date", "first_date") + 1)
    c = counted.withColumn("coverage", F.col("_n") / length)
    nearness = F.struct("distance_km", "ghcnd_id")
    full = F.when(F.col("coverage") >= SNOW_MIN_COVERAGE, nearness)
    # of equally covered ones the nearest
    scored = c.withColumn("_best", F.max("coverage").over(Window.partitionBy(*k)))
    pick = F.struct("ghcnd_id", "distance_km", (100.0 * F.col("coverage")).alias("coverage_pct"))
    return scored.groupBy(*k).agg(F.coalesce(F.min_by(pick, full), F.min_by(pick, F.when(F.col("coverage") == F.col("_best"), nearness)))
                                  .alias("s")).select(*k, "s.*")


def locate(places: DataFrame, centroids: DataFrame, text: str = "location") -> DataFrame:
    """Coordinates from 'lat, lon' text or a ZIP code; ``basis`` says which, or what is wrong."""
    words = F.filter(F.split(F.trim(F.col(text)), "[, ]+"), lambda w: F.length(w) > 0)
    commas = F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit(",")))

    def without_digits(w: Column) -> Column:
        return F.translate(w, "0123456789", "")

    def degrees(i: int) -> Column:
        w = F.get(words, F.lit(i))
        return F.when(without_digits(w).isin("", "-", ".", "-."), w.try_cast("double"))

    lat, lon = degrees(0), degrees(1)
    pair = F.coalesce((F.size(words) == 2) & (commas <= 1) & lat.isNotNull() & lon.isNotNull(), F.lit(False))
    ok = pair & lat.between(-90, 90) & lon.between(-180, 180)
    code, more = F.substring(F.get(words, F.lit(0)), 1, 5), F.substring(F.get(words, F.lit(0)), 6, 99)
    zipped = (F.length(code) == 5) & (without_digits(code) == "") & ((more == "") | (F.length(more) == 5) & (without_digits(more) == "-") & more.startswith("-"))
    zip_code = F.when(~pair & (F.size(words) == 1) & zipped, code)
    c = centroids.select(F.col("zip").alias("_zip"), F.col("lat").alias("_zlat"), F.col("lon").alias("_zlon"))
    j = places.withColumn("_zip", zip_code).join(c, "_zip", "left")
    basis = (F.when(ok, "coordinates").when(pair, "outside the globe").when(F.col("_zlat").isNotNull(), "ZIP code centroid")
             .when(F.col("_zip").isNotNull(), "unknown ZIP code").otherwise("not a location"))
    return j.select(*places.columns, F.when(ok, lat).otherwise(F.col("_zlat")).alias("lat"),
                    F.when(ok, lon).otherwise(F.col("_zlon")).alias("lon"), basis.alias("basis"))

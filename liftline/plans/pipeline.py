"""Flights, weather, baselines, backtest, alerts and zones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline import schemas
from liftline.operators import alerts, asof, backtest, baselines, clusters, names
from liftline.operators import flights as flight_ops
from liftline.operators import weather as weather_ops
from liftline.operators.keyed import skew_safe_join
from liftline.plans import views as V
from liftline.plans.oracle_views import SOFIA, day, integer_text, iso, with_views
from liftline.plans.registry import query
from liftline.session import scratch_path
from liftline.sources import zones
from liftline.sources.tables import conform

# --- Flights ---------------------------------------------------------------------


def _raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flight records as text; some with a broken field."""
    key, pilot = F.col("o_orderkey"), F.col("o_custkey")
    kind = key % 13
    date = F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int")).cast("string")
    text = {
        "flight_id": (key + 1).cast("string"),
        "flight_date": F.when(kind == 1, "2024-02-30").otherwise(date),
        "pilot": F.concat(F.lit("pilot-"), pilot.cast("string")),
        "source": F.lit("log"),
        "source_url": F.when(kind == 2, " ").otherwise(F.concat(F.lit("https://flights.example/"), key.cast("string"))),
        "launch_area": F.concat(F.lit("area "), (pilot % 15).cast("string")),
        "start_latitude": F.when(kind == 3, "95.0").otherwise(F.concat((pilot % 4 + 41).cast("string"), F.lit(".5"))),
        "start_longitude": F.concat((pilot % 6 + 22).cast("string"), F.lit(".25")),
        "landing_latitude": F.when(kind == 5, "north").when(kind == 6, "44.5"),
        "landing_longitude": F.when(kind == 6, "181"),
        "distance_km": F.when(kind == 4, "far").otherwise(F.concat((key % 400).cast("string"), F.lit(".5"))),
        "duration_min": F.when(kind == 7, "1 h").when(kind != 8, (key % 600).cast("string")),
        "track_url": F.lit(None).cast("string"),
        "quality_note": F.lit("as flown"),
        "retrieved_at": F.when(kind == 9, "yesterday").otherwise("2024-03-01 00:00:00"),
    }
    return V.table(spark, sf_dir, "orders").select(*[c.alias(n) for n, c in text.items()])


@query(
    "b01_flight_records",
    f"""SELECT id AS flight_id, CASE WHEN kind <> 1 THEN {day("DATE '2024-01-01' + CAST((id - 1) % 30 AS INT)")} END AS flight_date,
  'pilot-' || o_custkey AS pilot, CASE WHEN kind <> 4 THEN (id - 1) % 400 + 0.5::DOUBLE END AS distance_km,
  CASE WHEN kind NOT IN (7, 8) THEN (id - 1) % 600 END AS duration_min, CASE kind WHEN 1 THEN 'flight_date' WHEN 2 THEN 'source_url'
    WHEN 3 THEN 'start_latitude' WHEN 4 THEN 'distance_km' WHEN 5 THEN 'landing_latitude' WHEN 6 THEN 'landing_longitude'
    WHEN 7 THEN 'duration_min' WHEN 9 THEN 'retrieved_at' END AS issue_path,
  CASE WHEN kind = 4 THEN NULL WHEN (id - 1) % 400 >= 300 THEN '300+' WHEN (id - 1) % 400 >= 200 THEN '200+'
    WHEN (id - 1) % 400 >= 100 THEN '100+' ELSE 'below 100' END AS distance_band
FROM (SELECT o_orderkey + 1 AS id, o_orderkey % 13 AS kind, o_custkey FROM orders) t""",
)
def flight_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records, good and quarantined, with the field that breaks a rule."""
    ingested = flight_ops.ingest_flights(_raw_flights(spark, sf_dir))
    return ingested.select(
        "record.flight_id", "record.flight_date", "record.pilot", "record.distance_km", "record.duration_min",
        F.get("issues", F.lit(0))["path"].alias("issue_path"),
        flight_ops.distance_band(F.col("record.distance_km")).alias("distance_band"),
    )


@query(
    "b02_distance_bands",
    with_views(
        ("flights_x",),
        """SELECT flight_id, distance_km >= 100 AS reached_100, distance_km >= 200 AS reached_200, distance_km >= 300 AS reached_300,
  CASE WHEN distance_km >= 300 THEN '300+' WHEN distance_km >= 200 THEN '200+' WHEN distance_km >= 100 THEN '100+' ELSE 'below 100' END AS band
FROM flights_x""",
    ),
)
def distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = F.col("distance_km")
    flags = [c.alias(n) for n, c in flight_ops.distance_flags(distance).items()]
    return V.flights(spark, sf_dir).select("flight_id", *flags, flight_ops.distance_band(distance).alias("band"))


_COPIES_SQL = """SELECT l_orderkey * 8 + l_linenumber AS flight_id, l_orderkey % 15 + 1 AS site_id,
  DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS flight_date, l_orderkey % 300 AS pilot_key,
  CASE WHEN l_orderkey % 11 <> 5 THEN CAST((l_orderkey % 4000) * 100 + l_linenumber * l_linenumber * 13 AS DOUBLE) / 1000 END AS distance_km,
  CASE WHEN l_linenumber <> 7 THEN 'https://flights.example/' || l_orderkey || '/' || l_linenumber END AS source_url,
  l_shipdate AS retrieved_at FROM lineitem"""


@query(
    "b03_duplicate_flights",
    f"""SELECT site_id, {day('flight_date')} AS flight_date, pilot_key, arg_min(flight_id, (retrieved_at, flight_id)) AS flight_id,
  first(distance_km ORDER BY retrieved_at, flight_id) AS distance_km, first(source_url ORDER BY retrieved_at, flight_id) AS source_url,
  {iso('min(retrieved_at)')} AS retrieved_at, count(*) AS copies, count(*) FILTER (WHERE source_url IS NULL) AS untraceable,
  min(m) / 1000 AS least_km, max(m) / 1000 AS largest_km FROM (
SELECT *, sum(CASE WHEN m - before <= 100 OR (m IS NULL AND place > 1) THEN 0 ELSE 1 END) OVER w AS chain FROM (
  SELECT *, lag(m) OVER w AS before, row_number() OVER w AS place FROM (SELECT *, CAST(round(distance_km * 1000) AS BIGINT) AS m FROM ({_COPIES_SQL}) a) b
  WINDOW w AS (PARTITION BY site_id, flight_date, pilot_key ORDER BY m NULLS FIRST, flight_id)) c
WINDOW w AS (PARTITION BY site_id, flight_date, pilot_key ORDER BY m NULLS FIRST, flight_id)) d
GROUP BY site_id, flight_date, pilot_key, chain""",
)
def duplicate_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one order lie 39 to 169 m apart, so they form chains longer than the tolerance."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    url = F.concat(F.lit("https://flights.example/"), order.cast("string"), F.lit("/"), line.cast("string"))
    metres = (order % 4000) * 100 + line * line * 13
    copies = V.table(spark, sf_dir, "lineitem").select(
        (order * 8 + line).alias("flight_id"), (order % 15 + 1).alias("site_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (order % 30).cast("int")).alias("flight_date"),
        (order % 300).alias("pilot_key"), F.when(order % 11 != 5, metres.cast("double") / 1000).alias("distance_km"),
        F.when(line != 7, url).alias("source_url"), F.col("l_shipdate").cast("timestamp").alias("retrieved_at"),
    )
    return flight_ops.without_duplicates(copies)


_KM_SQL = """round(asin(sqrt(least(pow(sin(radians(s.latitude - f.lat) / 2), 2)
  + cos(radians(f.lat)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - f.lon) / 2), 2), 1.0::DOUBLE))) * 12742.0::DOUBLE, 6)"""


@query(
    "b04_launch_assignment",
    with_views(
        ("sites_x",),
        """SELECT flight_id, coalesce(named, near_id) AS launch_id,
  CASE WHEN named IS NOT NULL THEN 'name' WHEN near_id IS NOT NULL THEN 'radius' ELSE 'none' END AS method,
  CASE WHEN named IS NULL THEN CASE WHEN km <= 1 THEN 'launch' WHEN km <= 5 THEN 'cluster' WHEN km IS NOT NULL THEN 'region' END END AS scope,
  CASE WHEN named IS NULL THEN round(km, 3) END AS distance_km
FROM fl LEFT JOIN (SELECT * FROM near WHERE rn = 1) n USING (flight_id)""",
        fl="""SELECT o.o_orderkey AS flight_id, 41.0::DOUBLE + CAST(o_custkey % 640 AS DOUBLE) / 128 AS lat,
  22.0::DOUBLE + CAST(o_custkey % 730 AS DOUBLE) / 128 AS lon, a.id AS named
  FROM orders o LEFT JOIN sites_x a ON o.o_orderpriority = '1-URGENT' AND a.id = o.o_custkey % 40 * 7 + 1""",
        near=f"""SELECT f.flight_id, s.id AS near_id, {_KM_SQL} AS km,
  row_number() OVER (PARTITION BY f.flight_id ORDER BY {_KM_SQL}, s.id) AS rn
  FROM fl f JOIN sites_x s ON abs(s.latitude - f.lat) < 1 AND {_KM_SQL} <= CASE WHEN s.id % 10 = 0 THEN 25 ELSE 6 END""",
    ),
)
def launch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders carry a launch name, the others only coordinates."""
    site_rows = V.sites(spark, sf_dir)
    launches = site_rows.select(
        F.col("id").alias("launch_id"), "latitude", "longitude",
        F.when(F.col("id") % 10 == 0, 25.0).otherwise(6.0).alias("radius_km"),
    )
    names = site_rows.select(F.lower("name").alias("alias"), F.col("id").alias("launch_id"))
    pilot = F.col("o_custkey")
    written = F.concat(F.lit("\tSUPPLIER#"), F.lpad((pilot % 40 * 7).cast("string"), 9, "0"), F.lit(" "))
    flown = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("flight_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", written).alias("launch_area"),
        (F.lit(41.0) + (pilot % 640).cast("double") / 128).alias("start_latitude"),
        (F.lit(22.0) + (pilot % 730).cast("double") / 128).alias("start_longitude"),
    )
    return flight_ops.assign_launches(flown, launches, names)


_STARTS_SQL = """SELECT o_orderkey AS flight_id, 41.0::DOUBLE + CAST(o_custkey % 640 AS DOUBLE) / 128 AS lat,
  CASE WHEN o_custkey % 9 <> 0 THEN 178.0::DOUBLE + CAST(o_custkey % 730 AS DOUBLE) / 128 END AS lon, o_custkey FROM orders"""


def _cell_sql(lat: str, lon: str, degrees: float) -> str:
    around = round(360 / degrees)
    column = f"CAST(floor(({lon} + 180) / {degrees}::DOUBLE) AS BIGINT)"
    return f"CAST(floor(({lat} + 90) / {degrees}::DOUBLE) AS BIGINT) * {around} + (({column} % {around}) + {around}) % {around}"


def _cluster_sql(name: str, degrees: float, least: int) -> dict[str, str]:
    """Cells of a cluster by reachability over all pairs of touching cores."""
    around = round(360 / degrees)
    touch = f"""abs(a.cell // {around} - b.cell // {around}) <= 1 AND (abs(a.cell % {around} - b.cell % {around}) <= 1
    OR abs(a.cell % {around} - b.cell % {around}) = {around} - 1)"""
    return {
        f"{name}_cells": f"SELECT {_cell_sql('lat', 'lon', degrees)} AS cell, count(*) AS n FROM starts WHERE lon IS NOT NULL GROUP BY 1",
        f"{name}_reach": f"""SELECT cell AS a, cell AS b FROM {name}_cells WHERE n >= {least}
  UNION SELECT r.a, b.cell FROM {name}_reach r JOIN {name}_cells a ON a.cell = r.b JOIN {name}_cells b ON b.n >= {least} AND {touch}""",
        f"{name}_cores": f"SELECT a AS cell, min(b) AS id FROM {name}_reach GROUP BY a",
        f"{name}s": f"""SELECT b.cell, coalesce(min(CASE WHEN a.cell = b.cell THEN id END), min(id)) AS id FROM {name}_cells b
  JOIN {name}_cores a ON {touch} GROUP BY b.cell""",
    }


_CLUSTER_GRID, _REGION_GRID = (0.25, 40), (1.0, 500)


@query(
    "b04_launch_areas",
    with_views(
        ("sites_x",),
        f"""SELECT f.flight_id, c.id AS cluster_id, r.id AS region_id, coalesce(lc.launch_id, lr.launch_id) AS launch_id,
  CASE WHEN lc.launch_id IS NOT NULL THEN 'cluster' WHEN lr.launch_id IS NOT NULL THEN 'region' ELSE 'none' END AS area
FROM starts f LEFT JOIN clusters c ON c.cell = {_cell_sql('f.lat', 'f.lon', _CLUSTER_GRID[0])}
LEFT JOIN regions r ON r.cell = {_cell_sql('f.lat', 'f.lon', _REGION_GRID[0])}
LEFT JOIN (SELECT c.id, min(l.id) AS launch_id FROM launches l JOIN clusters c ON c.cell = {_cell_sql('l.lat', 'l.lon', _CLUSTER_GRID[0])} GROUP BY c.id) lc ON lc.id = c.id
LEFT JOIN (SELECT r.id, min(l.id) AS launch_id FROM launches l JOIN regions r ON r.cell = {_cell_sql('l.lat', 'l.lon', _REGION_GRID[0])} GROUP BY r.id) lr ON lr.id = r.id""",
        starts=_STARTS_SQL,
        launches="SELECT id, latitude AS lat, longitude + 157 AS lon FROM sites_x WHERE id % 3 = 0",
        **_cluster_sql("cluster", *_CLUSTER_GRID),
        **_cluster_sql("region", *_REGION_GRID),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def launch_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters and regions of starts on both sides of the date line."""
    pilot = F.col("o_custkey")
    flown = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("flight_id"), (F.lit(41.0) + (pilot % 640).cast("double") / 128).alias("start_latitude"),
        F.when(pilot % 9 != 0, F.lit(178.0) + (pilot % 730).cast("double") / 128).alias("start_longitude"),
    )
    launches = V.sites(spark, sf_dir).where("id % 3 = 0").select(
        F.col("id").alias("launch_id"), "latitude", (F.col("longitude") + 157).alias("longitude")
    )
    return clusters.assign_areas(flown, launches, _CLUSTER_GRID, _REGION_GRID)


_MISSPELT_SQL = """SELECT o_orderkey AS flight_id, CASE o_orderkey % 8 WHEN 0 THEN '  ' || n_name || ' ' WHEN 1 THEN left(n_name, p - 1) || substr(n_name, p + 1)
    WHEN 2 THEN left(n_name, p - 1) || 'x' || substr(n_name, p) WHEN 3 THEN left(n_name, p - 1) || 'Q' || substr(n_name, p + 1)
    WHEN 4 THEN 'y' || left(n_name, p - 1) || substr(n_name, p + 1) WHEN 5 THEN 'abc' || n_name WHEN 6 THEN n_name || repeat('z', 90) END AS written
  FROM (SELECT o_orderkey, o_custkey % 5 + 1 AS p, n_name FROM orders JOIN nation ON n_nationkey = o_custkey % 25) t"""


@query(
    "b04_misspelt_names",
    with_views(
        (),
        """SELECT w.flight_id, w.written, m.launch_id, CAST(m.errors AS INT) AS errors FROM written w LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY written ORDER BY errors, launch_id) AS rn FROM (
    SELECT w.written, n_nationkey AS launch_id, levenshtein(lower(trim(w.written)), lower(n_name)) AS errors, length(n_name) AS n
    FROM (SELECT DISTINCT written FROM written) w, nation) p
  WHERE errors <= CASE WHEN n >= 7 THEN 2 WHEN n >= 4 THEN 1 ELSE 0 END) m ON m.written = w.written AND m.rn = 1""",
        written=_MISSPELT_SQL,
    ),
)
def misspelt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launch names with characters missing, too many or wrong, some beyond recognition."""
    key, name = F.col("o_orderkey"), F.col("n_name")
    place = (F.col("o_custkey") % 5 + 1).cast("int")
    ahead, rest, after = F.substring(name, F.lit(1), place - 1), F.substring(name, place, F.length(name)), F.substring(name, place + 1, F.length(name))
    written = (
        F.when(key % 8 == 0, F.concat(F.lit("  "), name, F.lit(" "))).when(key % 8 == 1, F.concat(ahead, after))
        .when(key % 8 == 2, F.concat(ahead, F.lit("x"), rest)).when(key % 8 == 3, F.concat(ahead, F.lit("Q"), after))
        .when(key % 8 == 4, F.concat(F.lit("y"), ahead, after)).when(key % 8 == 5, F.concat(F.lit("abc"), name))
        .when(key % 8 == 6, F.concat(name, F.repeat(F.lit("z"), 90)))
    )
    nations = V.table(spark, sf_dir, "nation")
    flown = V.table(spark, sf_dir, "orders").withColumn("n_nationkey", F.col("o_custkey") % 25).join(nations, "n_nationkey")
    flown = flown.select(key.alias("flight_id"), written.alias("written"))
    found = names.match_names(flown, nations.select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("launch_id")), "written")
    return skew_safe_join(flown, found, ["written"]).select("flight_id", "written", "launch_id", "errors")


@query(
    "b05_quality_profile",
    with_views(
        ("weather_x",),
        """SELECT flag AS source, n_rows, u.check, u.n_bad, u.n_bad / n_rows AS rate, u.threshold, u.n_bad / n_rows <= u.threshold AS passed
FROM (SELECT flag, count(*) AS n_rows, count(*) FILTER (WHERE tax = 0) AS m, count(*) FILTER (WHERE temp_c > 45) AS h,
    count(*) FILTER (WHERE dew_point_c > temp_c) AS d, count(*) FILTER (WHERE run_age > 6) AS a FROM weather_x GROUP BY flag) t
CROSS JOIN LATERAL (VALUES ('dew point missing', m, 0.05::DOUBLE), ('temperature out of range', h, 0.2::DOUBLE),
  ('dew point above temperature', d, 0.0::DOUBLE), ('run too old', a, 0.2::DOUBLE)) AS u(check, n_bad, threshold)""".replace("u.check", 'u."check"').replace("u(check", 'u("check"'),
    ),
)
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.weather(spark, sf_dir).withColumn("dew", F.when(F.col("tax") != 0, F.col("dew_point_c")))
    checks = {
        "dew point missing": F.col("dew").isNull(),
        "temperature out of range": F.col("temp_c") > 45,
        "dew point above temperature": F.col("dew_point_c") > F.col("temp_c"),
        "run too old": F.col("run_age") > 6,
    }
    limits = {
        "dew point missing": 0.05, "temperature out of range": 0.2,
        "dew point above temperature": 0.0, "run too old": 0.2,
    }
    return flight_ops.quality_profile(rows, "flag", checks, limits).withColumnRenamed("flag", "source")


# --- Weather ---------------------------------------------------------------------


@query(
    "b06_weather_features",
    with_views(
        ("weather_x",),
        f"""SELECT site_id, {day('valid_date')} AS valid_date, {iso('model_run_time')} AS model_run_time, temp_c, dew_point_c,
  500 + row_part % 40 * 50.0::DOUBLE AS boundary_layer_height_m, run_age * 5.0::DOUBLE AS lowest_wind_kmh,
  greatest(0::DOUBLE, 100 - 5 * (temp_c - dew_point_c)) AS humidity_pct, cape_j_per_kg, tax * 1000 AS cloud_cover_pct,
  'archive-' || flag AS source FROM weather_x""",
    ),
)
def weather_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weather_table(spark, sf_dir)
    return rows.select(
        "site_id", "valid_date", "model_run_time", "temp_c", "dew_point_c", "boundary_layer_height_m",
        F.get("wind_by_altitude", F.lit(0))["speedKmh"].alias("lowest_wind_kmh"),
        "humidity_pct", "cape_j_per_kg", "cloud_cover_pct", "source",
    )


def weather_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.col("run_age").cast("double")
    winds = F.array(
        F.struct(F.lit(1500.0).alias("altitudeMslM"), F.lit(270.0).alias("directionDeg"), (age * 5).alias("speedKmh")),
        F.struct(F.lit(2500.0).alias("altitudeMslM"), F.lit(280.0).alias("directionDeg"), (age * 6).alias("speedKmh")),
    )
    rows = V.weather(spark, sf_dir).select(
        "site_id", "valid_date", "model_run_time", "temp_c", "dew_point_c",
        (500 + F.col("row_part") % 40 * F.lit(50.0)).alias("boundary_layer_height_m"),
        (age / 2).alias("thermal_strength_mps"), winds.alias("wind_by_altitude"),
        F.greatest(F.lit(0.0), 100 - 5 * (F.col("temp_c") - F.col("dew_point_c"))).alias("humidity_pct"),
        "cape_j_per_kg", F.lit(None).cast("double").alias("cin_j_per_kg"),
        (F.col("row_part") % 5).cast("double").alias("precipitation_mm"),
        (F.col("tax") * 1000).alias("cloud_cover_pct"),
        F.concat(F.lit("archive-"), F.col("flag")).alias("source"),
    )
    return conform(rows, schemas.WEATHER_FEATURES)


def _sounding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four level lines per order; some with a wrong token, a short line or no text."""
    key = F.col("o_orderkey")
    kind = key % 11

    def line(i: int) -> Column:
        values = [
            F.lit(1000 - 100 * i), 100 + 900 * i + key % 50,
            F.when((kind == 1) & F.lit(i == 1), "xx").otherwise((20 - 6 * i + key % 7).cast("string")),
            20 - 6 * i + key % 7 - key % 9, (key * 7 + 10 * i) % 360, 5 + i + key % 4,
        ]
        if i == 2:
            values[5] = F.when(kind != 2, values[5].cast("string"))
        if i == 3:
            values[3] = F.when(kind == 4, "NaN").when(kind == 5, "Infinity").otherwise(values[3].cast("string"))
        return F.concat_ws(" ", *[v.cast("string") for v in values])

    text = F.when(kind == 3, " ").otherwise(F.concat_ws("\n", *[line(i) for i in (3, 0, 1, 2)]))
    return V.table(spark, sf_dir, "orders").select(key.alias("sounding_id"), text.alias("raw_sounding_data"))


# The levels that can be read, with their place among them.
_LEVELS_SQL = """SELECT sounding_id, CASE WHEN kind = 3 THEN 'empty' WHEN kind IN (1, 2, 4, 5) THEN 'partial' ELSE 'ok' END AS quality_flag,
  row_number() OVER (PARTITION BY sounding_id ORDER BY place) - 1 AS pos, CAST(1000 - 100 * i AS DOUBLE) AS pressure_hpa,
  CAST(100 + 900 * i + sounding_id % 50 AS DOUBLE) AS height_m, CAST(20 - 6 * i + sounding_id % 7 AS DOUBLE) AS temp_c,
  CAST(20 - 6 * i + sounding_id % 7 - sounding_id % 9 AS DOUBLE) AS dew_point_c,
  CAST((sounding_id * 7 + 10 * i) % 360 AS DOUBLE) AS wind_direction_deg, CAST(5 + i + sounding_id % 4 AS DOUBLE) AS wind_speed_mps
FROM (SELECT o_orderkey AS sounding_id, o_orderkey % 11 AS kind FROM orders) o
CROSS JOIN (VALUES (0, 3), (1, 0), (2, 1), (3, 2)) AS l(place, i)
WHERE kind <> 3 AND NOT (kind = 1 AND i = 1) AND NOT (kind = 2 AND i = 2) AND NOT (kind IN (4, 5) AND i = 3)"""


@query(
    "b07_soundings",
    f"""SELECT sounding_id, quality_flag, CAST(pos AS INT) AS pos, pressure_hpa, height_m, temp_c, dew_point_c, wind_direction_deg, wind_speed_mps
FROM ({_LEVELS_SQL}) l UNION ALL SELECT o_orderkey, 'empty', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 11 = 3""",
)
def soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = weather_ops.parse_soundings(_sounding_texts(spark, sf_dir))
    return weather_ops.sounding_level_rows(parsed, ["sounding_id"])


_NEWEST = ["model_run_time", "row_order", "row_part", "cape_j_per_kg", "temp_c", "dew_point_c"]


def known_weather(spark: SparkSession, sf_dir: str, lead_days: int) -> DataFrame:
    newest_first = [F.col(name).desc() for name in _NEWEST]
    return weather_ops.weather_known_then(V.weather(spark, sf_dir), newest_first, lead_days)


def _known_sql(lead_days: int) -> str:
    order = ", ".join(f"{name} DESC" for name in _NEWEST)
    cut = f"(((valid_date - {lead_days})::TIMESTAMP AT TIME ZONE 'Europe/Sofia') AT TIME ZONE 'UTC')"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, valid_date ORDER BY {order}) AS rn
  FROM weather_x WHERE model_run_time <= {cut}) t WHERE rn = 1"""


@query(
    "b08_flights_with_weather",
    with_views(
        ("flights_x", "weather_x"),
        f"""SELECT f.flight_id, f.site_id, {day('f.flight_date')} AS flight_date, f.distance_km,
  {iso('k.model_run_time')} AS model_run_time, k.temp_c, k.cape_j_per_kg
FROM flights_x f LEFT JOIN known k ON k.site_id = f.site_id AND k.valid_date = f.flight_date""",
        known=_known_sql(1),
    ),
)
def flights_with_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    flown = V.flights(spark, sf_dir).select("flight_id", "site_id", "flight_date", "distance_km")
    known = known_weather(spark, sf_dir, 1).select("site_id", "valid_date", "model_run_time", "temp_c", "cape_j_per_kg")
    return weather_ops.flights_with_weather(flown, known).select(
        "flight_id", "site_id", "flight_date", "distance_km", "model_run_time", "temp_c", "cape_j_per_kg"
    )


_LAUNCHED_SQL = """SELECT flight_id, CASE WHEN pilot_key % 3 = 0 THEN 1 ELSE site_id END AS site_id, flight_date, distance_km,
  CASE WHEN pilot_key % 50 <> 0 THEN flight_date::TIMESTAMP + to_minutes(CAST(pilot_key % 97 * 17 - 800 AS BIGINT)) END AS launched_at FROM flights_x"""


@query(
    "b08_flights_as_of_launch",
    with_views(
        ("flights_x", "weather_x"),
        f"""SELECT l.flight_id, l.site_id, {iso('l.launched_at')} AS launched_at, {iso('w.model_run_time')} AS model_run_time, w.temp_c, w.cape_j_per_kg
FROM launched l ASOF LEFT JOIN runs_x w ON w.site_id = l.site_id AND w.valid_date = l.flight_date AND l.launched_at >= w.model_run_time""",
        launched=_LAUNCHED_SQL,
        runs_x=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, valid_date, model_run_time
  ORDER BY {", ".join(f"{name} DESC" for name in _NEWEST[1:])}) AS rn FROM weather_x) t WHERE rn = 1""",
    ),
)
def flights_as_of_launch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flight with the run for its date that was known when it was launched; a third are at one site."""
    pilot = F.col("pilot_key")
    minutes = pilot % 97 * 17 - 800
    midnight = F.unix_timestamp(F.col("flight_date").cast("timestamp"))
    launched = V.flights(spark, sf_dir).select(
        "flight_id", F.when(pilot % 3 == 0, 1).otherwise(F.col("site_id")).cast("long").alias("site_id"),
        F.col("flight_date").alias("valid_date"), "distance_km",
        F.when(pilot % 50 != 0, F.timestamp_seconds(midnight + minutes * 60)).alias("launched_at"),
    )
    found = asof.as_of_join(
        launched, V.weather(spark, sf_dir), ["site_id", "valid_date"], "launched_at", "model_run_time",
        ["model_run_time", "temp_c", "cape_j_per_kg"], _NEWEST[1:],
    )
    return found.select("flight_id", "site_id", "launched_at", "found.model_run_time", "found.temp_c", "found.cape_j_per_kg")


@query(
    "b09_level_features",
    f"""SELECT o.o_orderkey AS sounding_id, round(lapse, 6) AS lapse_rate_c_per_km, round(shear, 6) AS wind_shear_mps_per_km, spread AS dew_point_spread_c
FROM orders o LEFT JOIN (SELECT sounding_id,
    (arg_min(temp_c, height_m) - arg_max(temp_c, height_m)) / ((max(height_m) - min(height_m)) / 1000) AS lapse,
    max(sqrt(pow(u - u0, 2) + pow(v - v0, 2)) / ((height_m - h0) / 1000)) AS shear,
    arg_min(temp_c - dew_point_c, height_m) AS spread FROM (
  SELECT *, lag(u) OVER w AS u0, lag(v) OVER w AS v0, lag(height_m) OVER w AS h0 FROM (
    SELECT *, wind_speed_mps * sin(radians(wind_direction_deg)) AS u, wind_speed_mps * cos(radians(wind_direction_deg)) AS v FROM ({_LEVELS_SQL}) a) b
  WINDOW w AS (PARTITION BY sounding_id ORDER BY height_m)) c GROUP BY sounding_id) f ON f.sounding_id = o.o_orderkey""",
)
def level_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = weather_ops.parse_soundings(_sounding_texts(spark, sf_dir))
    rows = weather_ops.with_level_features(parsed)
    return rows.select(
        "sounding_id",
        F.round("lapse_rate_c_per_km", 6).alias("lapse_rate_c_per_km"),
        F.round("wind_shear_mps_per_km", 6).alias("wind_shear_mps_per_km"),
        "dew_point_spread_c",
    )


# --- Baselines -------------------------------------------------------------------


@query(
    "b10_cloudbase_baseline",
    with_views(
        ("weather_x",),
        f"""SELECT site_id, {day('valid_date')} AS valid_date,
  greatest((temp_c - dew_point_c) * 125.0::DOUBLE + site_id % 20 * 100, 0::DOUBLE) AS cloudbase_m FROM known""",
        known=_known_sql(0),
    ),
)
def cloudbase_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = weather_ops.cloudbase_m(F.col("temp_c"), F.col("dew_point_c"), F.col("site_id") % 20 * 100)
    return known_weather(spark, sf_dir, 0).select("site_id", "valid_date", base.alias("cloudbase_m"))


_BEST_SQL = "SELECT site_id, flight_date, max(distance_km) AS best_km FROM flights_x GROUP BY site_id, flight_date"


def _bucket_sql(value: str, least: float, greatest: float, count: int) -> str:
    width = (greatest - least) / count
    edges = " ".join(f"WHEN {value} < {least + i * width}::DOUBLE THEN {i}" for i in range(count + 1))
    return f"CASE WHEN {value} IS NULL THEN NULL {edges} ELSE {count + 1} END"


_BUCKETED_SQL = f"""SELECT k.*, b.best_km, {_bucket_sql('k.cape_j_per_kg', *baselines.CAPE_GRID)} AS cape_bucket,
  {_bucket_sql('(k.temp_c - k.dew_point_c)', *baselines.SPREAD_GRID)} AS spread_bucket
  FROM known k LEFT JOIN best b ON b.site_id = k.site_id AND b.flight_date = k.valid_date"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_weather(spark, sf_dir, 0).select("site_id", "valid_date", "temp_c", "dew_point_c", "cape_j_per_kg")


_SCORED = {
    "known": _known_sql(0),
    "best": _BEST_SQL,
    "bucketed": _BUCKETED_SQL,
    "counted": """SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE best_km >= 100) OVER w AS n100,
    count(*) FILTER (WHERE best_km >= 200) OVER w AS n200, count(*) FILTER (WHERE best_km >= 300) OVER w AS n300
  FROM bucketed WINDOW w AS (PARTITION BY cape_bucket, spread_bucket ORDER BY valid_date
    RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
    "scored": """SELECT * EXCLUDE (n), nullif(n, 0) AS n, (n100 + 1) / nullif(n + 2, 2) * 100 AS p100, (n200 + 1) / nullif(n + 2, 2) * 100 AS p200,
  (n300 + 1) / nullif(n + 2, 2) * 100 AS p300 FROM counted""",
}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = baselines.best_distances(V.flights(spark, sf_dir))
    return baselines.chances_from_earlier_days(_days(spark, sf_dir), best)


@query(
    "b11_xc_probability",
    with_views(
        ("flights_x", "weather_x"),
        f"""SELECT site_id, {day('valid_date')} AS valid_date, cape_bucket, spread_bucket, n AS n_examples,
  p100, p200, p300, CASE WHEN n < 30 THEN 'low' WHEN n < 200 THEN 'medium' WHEN n IS NOT NULL THEN 'high' END AS confidence_level
FROM scored""",
        **_SCORED,
    ),
)
def xc_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "site_id", "valid_date", "cape_bucket", "spread_bucket", "n_examples", "p100", "p200", "p300", "confidence_level"
    )


def _score_sql(name: str) -> str:
    column, one, two = baselines.RISK_SCORES[name]
    return f"CASE WHEN {column} >= {two} THEN 2 WHEN {column} >= {one} THEN 1 ELSE 0 END"


_RISK_ROWS_SQL = f"""SELECT *, {_score_sql('CAPE')} AS s1, {_score_sql('Cloud cover')} AS s2, {_score_sql('Humidity')} AS s3,
  {_score_sql('Precipitation')} AS s4 FROM (SELECT row_order, run_age, row_part, cape_j_per_kg, tax * 1000 AS cloud_cover_pct,
    greatest(0::DOUBLE, 100 - 5 * (temp_c - dew_point_c)) AS humidity_pct, row_part % 5 AS precipitation_mm FROM weather_x) t"""


@query(
    "b12_overdevelopment",
    with_views(
        ("weather_x",),
        """SELECT row_order, run_age, row_part, s1 + s2 + s3 + s4 AS od_score,
  CASE WHEN s1 + s2 + s3 + s4 <= 2 THEN 'low' WHEN s1 + s2 + s3 + s4 <= 4 THEN 'medium' ELSE 'high' END AS od_risk,
  array_to_string(list_transform(list_slice(list_sort([x for x in [{'o': -s1, 'n': 'CAPE'}, {'o': -s2, 'n': 'Cloud cover'},
    {'o': -s3, 'n': 'Humidity'}, {'o': -s4, 'n': 'Precipitation'}] if x.o < 0]), 1, 2), lambda x: x.n), ', ') AS od_drivers FROM scored""",
        scored=_RISK_ROWS_SQL,
    ),
)
def overdevelopment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.weather(spark, sf_dir).withColumns(
        {
            "cloud_cover_pct": F.col("tax") * 1000,
            "humidity_pct": F.greatest(F.lit(0.0), 100 - 5 * (F.col("temp_c") - F.col("dew_point_c"))),
            "precipitation_mm": (F.col("row_part") % 5).cast("double"),
        }
    )
    scored = rows.withColumns(baselines.overdevelopment())
    return scored.select(
        "row_order", "run_age", "row_part", "od_score", "od_risk",
        F.array_join("od_drivers", ", ").alias("od_drivers"),
    )


def _ranked_sql(scope: str, key: str) -> str:
    return f"""SELECT '{scope}' AS scope, site_id, {day('forecast_date')} AS forecast_date, p100, rank FROM (
  SELECT *, rank() OVER (PARTITION BY {key} ORDER BY p100 DESC) AS rank FROM preds
  WHERE p100 IS NOT NULL AND forecast_date >= DATE '2024-01-10') t WHERE rank <= 3"""


@query(
    "b13_ranked_days",
    with_views(
        ("preds",),
        f"{_ranked_sql('days of a site', 'site_id')} UNION ALL {_ranked_sql('sites of a day', 'forecast_date')}",
    ),
)
def ranked_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.predictions(spark, sf_dir).select("site_id", "forecast_date", "p100")
    reference = F.lit("2024-01-10").cast("date")
    days = baselines.best_days_per_site(rows, reference, 3).withColumn("scope", F.lit("days of a site"))
    sites = baselines.best_sites_per_day(rows, reference, 3).withColumn("scope", F.lit("sites of a day"))
    return days.unionByName(sites)


_SCALE_SQL = ", ".join(
    f"""sqrt((CAST(sum(CAST(round({name} * 100) AS BIGINT) * CAST(round({name} * 100) AS BIGINT))::BIGINT AS DOUBLE)
    - CAST(sum(CAST(round({name} * 100) AS BIGINT))::BIGINT AS DOUBLE) * CAST(sum(CAST(round({name} * 100) AS BIGINT))::BIGINT AS DOUBLE) / count(*))
    / count(*)) / 100.0::DOUBLE AS s_{name}"""
    for name in baselines.FEATURES
)


@query(
    "b14_similar_days",
    with_views(
        ("flights_x", "weather_x"),
        f"""SELECT site_id, {day('valid_date')} AS valid_date, {day('similar_date')} AS similar_date, distance_sq, rank FROM (
SELECT u.site_id, u.valid_date, h.valid_date AS similar_date, {{}} AS distance_sq,
  row_number() OVER (PARTITION BY u.site_id, u.valid_date ORDER BY {{}}, h.valid_date) AS rank
FROM days u JOIN days h ON h.site_id = u.site_id CROSS JOIN scales
WHERE u.valid_date >= DATE '2024-01-21' AND h.valid_date < DATE '2024-01-21' AND h.best_km >= 200) t WHERE rank <= 3""".replace(
            "{}", "round(" + " + ".join(f"pow(u.{n} / s_{n} - h.{n} / s_{n}, 2)" for n in baselines.FEATURES) + ", 9)"
        ),
        known=_known_sql(0), best=_BEST_SQL,
        days="""SELECT k.site_id, k.valid_date, k.temp_c, k.temp_c - k.dew_point_c AS spread_c, k.cape_j_per_kg, b.best_km
  FROM known k LEFT JOIN best b ON b.site_id = k.site_id AND b.flight_date = k.valid_date""",
        scales=f"SELECT {_SCALE_SQL} FROM days",
    ),
)
def similar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _days(spark, sf_dir).withColumn("spread_c", F.col("temp_c") - F.col("dew_point_c"))
    labelled = baselines.label_days(features, baselines.best_distances(V.flights(spark, sf_dir)))
    split = F.lit("2024-01-21").cast("date")
    history = labelled.where((F.col("valid_date") < split) & (F.col("best_km") >= 200))
    upcoming = features.where(F.col("valid_date") >= split)
    return baselines.similar_days(upcoming, history, baselines.feature_scales(features), 3)


# --- Backtest --------------------------------------------------------------------

_JUDGED_SQL = """SELECT p.site_id, p.forecast_date, t.km AS threshold_km,
  CASE t.km WHEN 100 THEN p100 WHEN 200 THEN p200 ELSE p300 END AS chance, coalesce(b.best_km >= t.km, false) AS reached
  FROM preds p CROSS JOIN (VALUES (100), (200), (300)) AS t(km)
  LEFT JOIN best b ON b.site_id = p.site_id AND b.flight_date = p.forecast_date WHERE p.p100 IS NOT NULL"""
_BACKTEST_VIEWS = ("preds", "flights_x")
_BACKTEST = {"best": _BEST_SQL, "judged": _JUDGED_SQL}


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = baselines.best_distances(V.flights(spark, sf_dir))
    return backtest.judged(V.predictions(spark, sf_dir), best)


@query(
    "b15_backtest_report",
    with_views(
        _BACKTEST_VIEWS,
        """SELECT threshold_km, n_examples, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CAST(e AS DOUBLE) / n_examples / 1e10::DOUBLE AS brier FROM (
SELECT threshold_km, count(*) AS n_examples, count(*) FILTER (WHERE chance >= 50 AND reached) AS tp,
  count(*) FILTER (WHERE chance >= 50 AND NOT reached) AS fp, count(*) FILTER (WHERE chance < 50 AND reached) AS fn,
  count(*) FILTER (WHERE chance < 50 AND NOT reached) AS tn,
  CAST(sum(CAST(floor(pow(chance - CASE WHEN reached THEN 100 ELSE 0 END, 2) * 1000000) AS BIGINT)) AS BIGINT) AS e
FROM judged GROUP BY threshold_km) t""",
        **_BACKTEST,
    ),
)
def backtest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.backtest_report(_judged(spark, sf_dir))


@query(
    "b15_baseline_backtest",
    with_views(
        ("flights_x", "weather_x"),
        """SELECT threshold_km, n_examples, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CAST(e AS DOUBLE) / n_examples / 1e10::DOUBLE AS brier FROM (
SELECT threshold_km, count(*) AS n_examples, count(*) FILTER (WHERE chance >= 50 AND reached) AS tp,
  count(*) FILTER (WHERE chance >= 50 AND NOT reached) AS fp, count(*) FILTER (WHERE chance < 50 AND reached) AS fn,
  count(*) FILTER (WHERE chance < 50 AND NOT reached) AS tn,
  CAST(sum(CAST(floor(pow(chance - CASE WHEN reached THEN 100 ELSE 0 END, 2) * 1000000) AS BIGINT)) AS BIGINT) AS e
FROM tried GROUP BY threshold_km) t""",
        **_SCORED,
        tried="""SELECT t.km AS threshold_km, CASE t.km WHEN 100 THEN p100 WHEN 200 THEN p200 ELSE p300 END AS chance,
  coalesce(best_km >= t.km, false) AS reached FROM scored CROSS JOIN (VALUES (100), (200), (300)) AS t(km) WHERE p100 IS NOT NULL""",
    ),
)
def baseline_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of B11, for every day from the days before it, judged on what was flown."""
    scored = _scored(spark, sf_dir).withColumnRenamed("valid_date", "forecast_date")
    best = baselines.best_distances(V.flights(spark, sf_dir))
    return backtest.backtest_report(backtest.judged(scored, best))


@query(
    "b15_calibration",
    with_views(
        _BACKTEST_VIEWS,
        """SELECT threshold_km, bin, n_examples, n_reached, least_chance_pct, largest_chance_pct, CAST(c AS DOUBLE) / n_examples / 1000000 AS mean_chance_pct,
  n_reached / n_examples AS reached_share FROM (
SELECT threshold_km, CAST(bin AS INT) AS bin, count(*) AS n_examples, count(*) FILTER (WHERE reached) AS n_reached,
  min(chance) AS least_chance_pct, max(chance) AS largest_chance_pct, CAST(sum(CAST(floor(chance * 1000000) AS BIGINT)) AS BIGINT) AS c
FROM (SELECT *, ntile(10) OVER (PARTITION BY threshold_km ORDER BY chance, site_id, forecast_date) AS bin FROM judged) j GROUP BY threshold_km, bin) t""",
        **_BACKTEST,
    ),
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.calibration(_judged(spark, sf_dir))


@query(
    "b15_error_examples",
    with_views(
        _BACKTEST_VIEWS,
        f"""SELECT site_id, {day('forecast_date')} AS forecast_date, threshold_km, chance AS chance_pct, reached, error, rank FROM (
SELECT *, row_number() OVER (PARTITION BY threshold_km, error ORDER BY CASE WHEN chance >= 50 THEN -chance ELSE chance END, site_id, forecast_date) AS rank
FROM (SELECT *, CASE WHEN chance >= 50 AND NOT reached THEN 'false positive' WHEN chance < 50 AND reached THEN 'false negative' END AS error FROM judged) e
WHERE error IS NOT NULL) t WHERE rank <= 5""",
        **_BACKTEST,
    ),
)
def error_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.error_examples(_judged(spark, sf_dir), 5)


# --- Alerts ----------------------------------------------------------------------

_CREATED = SOFIA.replace("ts", "generated_at")
_ALERTS_SQL = f"""SELECT r.run_id, r.site_id, r.forecast_date, r.generated_at, CAST({_CREATED} AS DATE) AS created_date, t.km AS threshold_km,
  t.least AS threshold_pct, t.chance AS chance_pct, {integer_text('t.chance')} || '% chance of ' || t.km || '+ km on '
    || {day('r.forecast_date')} || ' at site ' || r.site_id || '.' AS message
  FROM runs r CROSS JOIN LATERAL (VALUES (100, 60.0::DOUBLE, r.p100), (200, 40.0::DOUBLE, r.p200), (300, 20.0::DOUBLE, r.p300)) AS t(km, least, chance)
  WHERE t.chance >= t.least AND date_diff('day', CAST({_CREATED} AS DATE), r.forecast_date) >= 1"""
_FRESH_SQL = """SELECT * FROM (SELECT c.*, s.run_id IS NOT NULL AS refreshed,
    row_number() OVER (PARTITION BY c.site_id, c.forecast_date, c.threshold_km ORDER BY c.generated_at, c.run_id) AS rn
  FROM (SELECT * FROM raised WHERE created_date >= DATE '2024-01-15') c LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY site_id, forecast_date, threshold_km ORDER BY generated_at DESC, run_id DESC) AS n
    FROM raised WHERE created_date < DATE '2024-01-15') s
  ON s.n = 1 AND s.site_id = c.site_id AND s.forecast_date = c.forecast_date AND s.threshold_km = c.threshold_km
  WHERE s.run_id IS NULL OR c.chance_pct >= s.chance_pct + 10) t WHERE rn = 1"""


def _raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.raise_alerts(V.prediction_runs(spark, sf_dir))


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts from 15 January on against those that were sent before."""
    raised, cut = _raised(spark, sf_dir), F.lit("2024-01-15").cast("date")
    return alerts.new_alerts(
        raised.where(F.col("created_date") >= cut), raised.where(F.col("created_date") < cut)
    )


@query(
    "b16_alerts",
    with_views(
        ("runs",),
        f"""SELECT run_id, site_id, {day('forecast_date')} AS forecast_date, {day('created_date')} AS created_date,
  threshold_km, threshold_pct, chance_pct, message FROM raised""",
        raised=_ALERTS_SQL,
    ),
)
def raised_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raised(spark, sf_dir).drop("generated_at")


@query(
    "b17_new_alerts",
    with_views(
        ("runs",),
        f"""SELECT run_id, site_id, {day('forecast_date')} AS forecast_date, {day('created_date')} AS created_date, threshold_km, chance_pct, refreshed FROM fresh""",
        raised=_ALERTS_SQL, fresh=_FRESH_SQL,
    ),
)
def new_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir).select(
        "run_id", "site_id", "forecast_date", "created_date", "threshold_km", "chance_pct", "refreshed"
    )


@query(
    "b18_watchlist",
    with_views(
        ("runs",),
        f"""SELECT {day('created_date')} AS created_date, site_id, count(*) AS n_alerts,
  string_agg(message, chr(10) ORDER BY forecast_date, threshold_km) AS text FROM fresh GROUP BY created_date, site_id""",
        raised=_ALERTS_SQL, fresh=_FRESH_SQL,
    ),
)
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.watchlist(_fresh(spark, sf_dir)).select("created_date", "site_id", "n_alerts", "text")


@query(
    "b18_daily_list",
    with_views(
        ("runs",),
        f"""SELECT {day('created_date')} AS created_date, CAST(page AS INT) AS page, CAST(ceil(n_alerts / 20) AS INT) AS n_pages, n_alerts,
  min(number) AS first_number, string_agg(number || '. ' || message, chr(10) ORDER BY number) AS text
FROM (SELECT *, (number - 1) // 20 + 1 AS page FROM (SELECT *, count(*) OVER (PARTITION BY created_date) AS n_alerts,
  row_number() OVER (PARTITION BY created_date ORDER BY site_id, forecast_date, threshold_km, run_id) AS number FROM fresh) n) p
GROUP BY created_date, page, n_alerts""",
        raised=_ALERTS_SQL, fresh=_FRESH_SQL,
    ),
)
def daily_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.daily_list(_fresh(spark, sf_dir), 20)


_RULES_SQL = """SELECT s_suppkey * 3 + i AS rule_id, s_suppkey % 40 + 1 AS site_id, i * 100 AS threshold_km, CAST(s_suppkey % 45 + 5 AS DOUBLE) AS threshold_pct,
    CASE WHEN s_suppkey % 4 <> 1 THEN DATE '2024-01-01' + CAST(s_suppkey * 7 % 40 AS INT) END AS valid_from,
    CASE WHEN s_suppkey % 5 <> 2 THEN DATE '2024-01-08' + CAST(s_suppkey * 11 % 60 AS INT) END AS valid_to FROM supplier, (VALUES (1), (2), (3)) AS v(i)
  UNION ALL SELECT -1 - r_regionkey, NULL, 100 + 100 * (r_regionkey % 3), 70.0::DOUBLE - 10 * r_regionkey, DATE '2024-01-03' + CAST(r_regionkey * 4 AS INT), NULL FROM region"""


@query(
    "b16_alerts_by_table",
    with_views(
        ("runs",),
        f"""SELECT run_id, site_id, {day('forecast_date')} AS forecast_date, {day('created_date')} AS created_date, threshold_km, threshold_pct, rule_id, chance_pct,
  {integer_text('chance_pct')} || '% chance of ' || threshold_km || '+ km on ' || {day('forecast_date')} || ' at site ' || site_id || '.' AS message
FROM (SELECT c.*, r.threshold_pct, r.rule_id, row_number() OVER (PARTITION BY c.run_id, c.threshold_km
    ORDER BY r.site_id IS NOT NULL DESC, r.valid_from DESC NULLS LAST, r.rule_id DESC) AS rn
  FROM chances c JOIN rules r ON r.threshold_km = c.threshold_km AND coalesce(r.site_id = c.site_id, true)
    AND coalesce(r.valid_from <= c.created_date, true) AND coalesce(r.valid_to > c.created_date, true)) t
WHERE rn = 1 AND chance_pct >= threshold_pct AND date_diff('day', created_date, forecast_date) >= 1""",
        rules=_RULES_SQL,
        chances=f"""SELECT run_id, site_id, forecast_date, CAST({_CREATED} AS DATE) AS created_date, t.km AS threshold_km, t.chance AS chance_pct
  FROM runs CROSS JOIN LATERAL (VALUES (100, p100), (200, p200), (300, p300)) AS t(km, chance)""",
    ),
)
def alerts_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of sites and of all sites, whose days overlap, are open or never hold."""
    key, i = F.col("s_suppkey"), F.col("i")
    start, end = F.lit("2024-01-01").cast("date"), F.lit("2024-01-08").cast("date")
    of_site = V.table(spark, sf_dir, "supplier").withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select(
        (key * 3 + i).alias("rule_id"), (key % 40 + 1).alias("site_id"), (i * 100).alias("threshold_km"),
        (key % 45 + 5).cast("double").alias("threshold_pct"),
        F.when(key % 4 != 1, F.date_add(start, (key * 7 % 40).cast("int"))).alias("valid_from"),
        F.when(key % 5 != 2, F.date_add(end, (key * 11 % 60).cast("int"))).alias("valid_to"),
    )
    region = F.col("r_regionkey")
    of_all = V.table(spark, sf_dir, "region").select(
        (-1 - region).alias("rule_id"), F.lit(None).cast("long").alias("site_id"), (100 + 100 * (region % 3)).cast("int").alias("threshold_km"),
        (70 - 10 * region).cast("double").alias("threshold_pct"),
        F.date_add(F.lit("2024-01-03").cast("date"), (region * 4).cast("int")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
    )
    raised = alerts.raise_alerts_by_table(V.prediction_runs(spark, sf_dir), of_site.unionByName(of_all))
    return raised.drop("generated_at")


def _sent_sql(batch: int, where: str, sent: str | None) -> str:
    """New alerts of one batch against the latest ones sent before it."""
    known = f"LEFT JOIN {sent} s ON s.site_id = c.site_id AND s.forecast_date = c.forecast_date AND s.threshold_km = c.threshold_km" if sent else ""
    open_ = "WHERE s.run_id IS NULL OR c.chance_pct >= s.chance_pct + 10" if sent else ""
    again = "s.run_id IS NOT NULL" if sent else "false"
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT c.*, {again} AS refreshed, 'day {batch}' AS batch, row_number() OVER (
    PARTITION BY c.site_id, c.forecast_date, c.threshold_km ORDER BY c.generated_at, c.run_id) AS rn
  FROM (SELECT * FROM raised WHERE {where}) c {known} {open_}) t WHERE rn = 1"""


def _kept_sql(new: str, old: str) -> str:
    return f"SELECT * FROM {new} UNION ALL SELECT * FROM {old} o WHERE NOT EXISTS (SELECT 1 FROM {new} n WHERE n.site_id = o.site_id AND n.forecast_date = o.forecast_date AND n.threshold_km = o.threshold_km)"


@query(
    "b17_sent_alerts",
    with_views(
        ("runs",),
        f"""SELECT run_id, site_id, {day('forecast_date')} AS forecast_date, {day('created_date')} AS created_date, threshold_km, chance_pct, refreshed, batch
FROM (SELECT * FROM sent1 UNION ALL SELECT * FROM sent2 UNION ALL SELECT * FROM sent3) t""",
        raised=_ALERTS_SQL,
        sent1=_sent_sql(1, "created_date < DATE '2024-01-10'", None),
        sent2=_sent_sql(2, "created_date >= DATE '2024-01-10' AND created_date < DATE '2024-01-20'", "sent1"),
        kept2=_kept_sql("sent2", "sent1"),
        sent3=_sent_sql(3, "created_date >= DATE '2024-01-20'", "kept2"),
    ),
)
def sent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches against a growing store; the second is run twice and sent once."""
    raised, created = _raised(spark, sf_dir), F.col("created_date")
    store = alerts.sent_alerts(spark, scratch_path(spark, "sent"))
    ten, twenty = F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date")
    batches = [raised.where(created < ten), raised.where((created >= ten) & (created < twenty)), raised.where(created >= twenty)]
    sent = [alerts.send_alerts(batches[n - 1], store, f"day {n}") for n in (1, 2, 2, 3)]
    rows = reduce(DataFrame.unionByName, [sent[0], sent[2], sent[3]])
    return rows.select("run_id", "site_id", "forecast_date", "created_date", "threshold_km", "chance_pct", "refreshed", "batch")


def _change_sql(column: str, name: str) -> str:
    before = f"lag({column}) OVER w"
    moved = (
        f"{before} || ' to ' || {column}"
        if column == "od_risk"
        else f"CASE WHEN {column} > {before} THEN '+' ELSE '-' END || format('{{:,}}', CAST(round(abs({column} - {before})) AS BIGINT))"
    )
    return f"""CASE WHEN lag(run_id) OVER w IS NULL THEN 'No previous run' WHEN {column} IS NULL OR {before} IS NULL THEN 'Unavailable'
    WHEN {column} = {before} THEN 'Unchanged' ELSE {moved} END AS {name}_change"""


@query(
    "b19_previous_run",
    with_views(
        ("runs",),
        f"""SELECT run_id, site_id, {day('forecast_date')} AS forecast_date, lag(run_id) OVER w AS previous_run_id,
  {", ".join(_change_sql(c, n) for c, n in alerts.COMPARED.items())}
FROM (SELECT * REPLACE (CASE WHEN data_status <> 'missing' THEN od_risk END AS od_risk) FROM runs) r
WINDOW w AS (PARTITION BY site_id, forecast_date ORDER BY generated_at, run_id)""",
    ),
)
def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.compare_runs(V.prediction_runs(spark, sf_dir))


# --- Zones -----------------------------------------------------------------------


@query(
    "b20_zones",
    with_views(
        ("ev",),
        f"""SELECT event_id, {day('ts')} AS event_date, value, 'feed-' || event_type AS source, 'km' AS units,
  '2024-02-01T00:00:00.000Z' AS run_time, 'v1' AS version, 'baseline' AS data_status FROM ev WHERE event_type <> 'error' AND k % 9 <> 0""",
    ),
)
def zone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the processed zone: untraceable and missing raw values stay in interim."""
    raw = V.event_rows(spark, sf_dir).select(
        "event_id", F.to_date("ts").alias("event_date"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("k") % 9 != 0, F.concat(F.lit("feed-"), F.col("event_type"))).alias("source"),
    )
    interim = zones.to_interim(raw, "source", "value")
    return zones.to_processed(interim, "km", "2024-02-01 00:00:00", "v1", "baseline")


@query(
    "b20_versions",
    with_views(
        ("ev",),
        f"""SELECT version, {day('d')} AS event_date, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS id_sum, max(value) AS largest FROM (
SELECT 1 AS version, CAST(ts AS DATE) AS d, event_id, value FROM ev WHERE k % 2 = 0
UNION ALL SELECT 2, CAST(ts AS DATE), event_id, value FROM ev WHERE k % 2 = 0 AND day(CAST(ts AS DATE)) % 3 <> 0
UNION ALL SELECT 2, CAST(ts AS DATE), event_id, value * 2 FROM ev WHERE day(CAST(ts AS DATE)) % 3 = 0) t GROUP BY version, d""",
    ),
)
def zone_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version replaces every third date; the first one stays readable."""
    rows = V.event_rows(spark, sf_dir).select("event_id", F.to_date("ts").alias("event_date"), "value", "k")
    first = rows.where("k % 2 = 0").drop("k")
    second = rows.where("day(event_date) % 3 = 0").drop("k").withColumn("value", F.col("value") * 2)
    table = zones.zone_table(spark, scratch_path(spark, "zones"), "processed", "events", first.schema, "event_date")
    numbers = [table.replace(batch, note) for batch, note in ((first, "first"), (second, "every third date"))]
    both = reduce(DataFrame.unionByName, [table.read(n).withColumn("version", F.lit(n)) for n in numbers])
    return both.groupBy("version", "event_date").agg(
        F.count("*").alias("n_rows"), F.sum("event_id").alias("id_sum"), F.max("value").alias("largest")
    )

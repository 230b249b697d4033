"""Flights, weather, baselines, alerts and zones against brute force and edge rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from liftline import schemas
from liftline.operators import alerts, backtest, baselines, flights, rules, weather
from liftline.sources import tables, zones
from tests import golden


def haversine(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    half = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * flights.EARTH_RADIUS_KM * math.asin(math.sqrt(min(half, 1.0)))


def test_launch_assignment_equals_brute_force(spark):
    """Also across the date line, near the pole and with a catchment wider than a cell."""
    random.seed(5)
    launches = [(i, random.uniform(41, 44), random.uniform(22, 29), random.choice([3.0, 20.0, 90.0])) for i in range(40)]
    launches += [(100, 10.0, 179.95, 60.0), (101, -10.0, -179.9, 60.0), (102, 88.5, 10.0, 200.0)]
    flown = [(i, random.uniform(40.5, 44.5), random.uniform(21, 30)) for i in range(400)]
    flown += [(900 + i, 10 + random.uniform(-1, 1), ((180 + random.uniform(-1, 1) + 180) % 360) - 180) for i in range(50)]
    flown += [(1000 + i, random.uniform(86, 89.9), random.uniform(-180, 180)) for i in range(50)]
    got = flights.assign_launches(
        spark.createDataFrame(flown, "flight_id long, start_latitude double, start_longitude double").withColumn("launch_area", F.lit(None).cast("string")),
        spark.createDataFrame(launches, "launch_id long, latitude double, longitude double, radius_km double"),
        spark.createDataFrame([], "alias string, launch_id long"),
    )
    rows = {r["flight_id"]: r["launch_id"] for r in got.collect()}
    want = {}
    for fid, lat, lon in flown:
        near = sorted((round(haversine(lat, lon, la, lo), 6), lid) for lid, la, lo, radius in launches if haversine(lat, lon, la, lo) <= radius)
        want[fid] = near[0][1] if near else None
    assert rows == want
    assert len({v for v in want.values()}) > 20


def test_written_launch_name_wins(spark):
    flown = spark.createDataFrame([(1, "\tSopot ", 43.0, 23.0), (2, "elsewhere", 43.0, 23.0)], "flight_id long, launch_area string, start_latitude double, start_longitude double")
    launches = spark.createDataFrame([(8, 43.0, 23.0, 5.0)], "launch_id long, latitude double, longitude double, radius_km double")
    names = spark.createDataFrame([("sopot", 3)], "alias string, launch_id long")
    rows = {r["flight_id"]: (r["launch_id"], r["method"], r["scope"]) for r in flights.assign_launches(flown, launches, names).collect()}
    assert rows == {1: (3, "name", None), 2: (8, "radius", "launch")}


@pytest.mark.parametrize("size", [3, 60])
def test_similar_days_equal_brute_force(spark, size):
    random.seed(size)
    start = dt.date(2020, 1, 1)

    def day(site, i):
        hot = (20.0, 3.0, 500.0) if i % 3 == 0 else (random.gauss(20, 8), random.uniform(0, 6), random.expovariate(1 / 400))
        return (site, start + dt.timedelta(days=i), *hot)

    history = [day(s, i) for s in (1, 2) for i in range(size)] + [(1, start + dt.timedelta(days=999), None, 1.0, 1.0)]
    upcoming = [day(s, 5000 + i) for s in (1, 2, 3) for i in range(12)]
    schema = "site_id long, valid_date date, temp_c double, spread_c double, cape_j_per_kg double"
    h, u = spark.createDataFrame(history, schema), spark.createDataFrame(upcoming, schema)
    scales = baselines.feature_scales(h.dropna())
    s = scales.first()
    got = baselines.similar_days(u, h, scales, 4)
    rows = sorted((r["site_id"], r["valid_date"], r["rank"], r["similar_date"]) for r in got.collect())
    want = []
    for site, date, *x in upcoming:
        near = sorted(
            (round(sum((a / c - b / c) ** 2 for a, b, c in zip(x, y, s)), 9), d)
            for hs, d, *y in history if hs == site and None not in y
        )[:4]
        want += [(site, date, n + 1, d) for n, (_q, d) in enumerate(near)]
    assert rows == sorted(want)


def test_constant_feature_does_not_break_scaling(spark):
    schema = "site_id long, valid_date date, temp_c double, spread_c double, cape_j_per_kg double"
    rows = spark.createDataFrame([(1, dt.date(2020, 1, i), 5.0, float(i), 1.0) for i in range(1, 6)], schema)
    got = baselines.similar_days(rows.limit(1), rows, baselines.feature_scales(rows), 1).collect()
    assert len(got) == 1


def test_flight_ingest_quarantines(spark):
    good = {"flight_id": "1", "flight_date": "2024-01-02", "source_url": "u", "start_latitude": "42", "start_longitude": "23", "distance_km": "120.5"}
    variants = [good, good | {"flight_date": "2024-1-2"}, good | {"distance_km": "NaN"}, good | {"start_latitude": "91"}, good | {"flight_id": "x"}]
    raw = spark.createDataFrame([tuple(v.get(f) for f in schemas.FLIGHT_RECORD.names) for v in variants], ", ".join(f"{f} string" for f in schemas.FLIGHT_RECORD.names))
    ok, bad = rules.split_by_issues(flights.ingest_flights(raw))
    assert ok.select("record.distance_km").first()[0] == 120.5 and ok.count() == 1
    assert sorted(r["issues"][0]["path"] for r in bad.collect()) == ["distance_km", "flight_date", "flight_id", "start_latitude"]


@pytest.mark.parametrize("km, band", [(99.9, "below 100"), (100.0, "100+"), (200.0, "200+"), (300.0, "300+"), (None, None)])
def test_band_boundary_counts(spark, km, band):
    df = spark.createDataFrame([(km,)], "d double")
    assert df.select(flights.distance_band(F.col("d")).alias("b")).first()["b"] == band


def test_sounding_text(spark):
    texts = [(1, "1000 100 20 10 180 5\n900  1000\t14 8 270 10\r\n"), (2, "x"), (3, None), (4, "900 1000 14 8 270 10\n1 2 3")]
    parsed = weather.parse_soundings(spark.createDataFrame(texts, "id int, raw_sounding_data string"))
    rows = {r["id"]: r for r in weather.with_level_features(parsed).collect()}
    assert [rows[i]["quality_flag"] for i in (1, 2, 4)] == ["ok", "empty", "partial"]
    assert rows[1]["lapse_rate_c_per_km"] == pytest.approx(6 / 0.9)
    assert rows[1]["wind_shear_mps_per_km"] == pytest.approx(math.hypot(10, 5) / 0.9)
    assert (rows[4]["lapse_rate_c_per_km"], rows[4]["wind_shear_mps_per_km"], rows[4]["dew_point_spread_c"]) == (None, None, 6)
    assert rows[2]["dew_point_spread_c"] is None


def test_weather_cut_off_is_the_local_start_of_day(spark):
    runs = [(1, "2024-07-10", "2024-07-09 21:00:00", 1), (1, "2024-07-10", "2024-07-09 21:00:01", 2), (1, "2024-01-10", "2024-01-09 22:00:00", 3)]
    df = spark.createDataFrame(runs, "site_id long, d string, t string, n int").select("site_id", F.col("d").cast("date").alias("valid_date"), F.col("t").cast("timestamp").alias("model_run_time"), "n")
    known = weather.weather_known_then(df, [F.col("model_run_time").desc()])
    assert sorted(r["n"] for r in known.collect()) == [1, 3]


def test_cloudbase(spark):
    row = spark.sql("SELECT 20.0D AS t, 12.0D AS d, 25.0D AS high").select(
        weather.cloudbase_m(F.col("t"), F.col("d"), F.lit(500)).alias("a"),
        weather.cloudbase_m(F.col("d"), F.col("high"), F.lit(0)).alias("b"),
        weather.cloudbase_m(F.lit(None).cast("double"), F.col("d"), F.lit(500)).alias("c"),
    ).first()
    assert tuple(row) == (1500.0, 0.0, None)


def runs(spark, rows):
    return spark.createDataFrame(rows, "run_id long, site_id long, f string, g string, p100 double, p200 double, p300 double").select(
        "run_id", "site_id", F.col("f").cast("date").alias("forecast_date"), F.col("g").cast("timestamp").alias("generated_at"), "p100", "p200", "p300"
    )


def test_alert_needs_a_day_of_lead_in_local_time(spark):
    raised = alerts.raise_alerts(runs(spark, [
        (1, 1, "2024-07-11", "2024-07-10 20:59:00", 60.0, 10.0, 0.0),
        (2, 1, "2024-07-11", "2024-07-10 21:00:00", 99.0, 10.0, 0.0),  # already the 11th in Sofia
        (3, 1, "2024-07-11", "2024-07-09 12:00:00", 59.9, 40.0, 20.0),
    ]))
    assert sorted((r["run_id"], r["threshold_km"]) for r in raised.collect()) == [(1, 100), (3, 200), (3, 300)]


def test_alert_is_not_repeated_unless_refreshed(spark):
    sent = alerts.raise_alerts(runs(spark, [(1, 1, "2024-07-20", "2024-07-10 08:00:00", 65.0, 0.0, 0.0), (2, 2, "2024-07-20", "2024-07-10 08:00:00", 65.0, 0.0, 0.0)]))
    batch = alerts.raise_alerts(runs(spark, [
        (3, 1, "2024-07-20", "2024-07-11 08:00:00", 74.9, 0.0, 0.0),
        (4, 2, "2024-07-20", "2024-07-11 08:00:00", 75.0, 0.0, 0.0),
        (5, 2, "2024-07-20", "2024-07-11 09:00:00", 80.0, 0.0, 0.0),
        (6, 3, "2024-07-20", "2024-07-11 08:00:00", 61.0, 0.0, 0.0),
    ]))
    fresh = alerts.new_alerts(batch, sent)
    assert sorted((r["run_id"], r["refreshed"]) for r in fresh.collect()) == [(4, True), (6, False)]
    lists = alerts.watchlist(fresh).collect()
    assert sorted(r["text"] for r in lists) == ["61% chance of 100+ km on 2024-07-20 at site 3.", "75% chance of 100+ km on 2024-07-20 at site 2."]


def test_backtest_counts(spark):
    judged = spark.createDataFrame(
        [(1, "2024-01-01", 100, 80.0, True), (1, "2024-01-02", 100, 60.0, False), (1, "2024-01-03", 100, 20.0, True), (1, "2024-01-04", 100, 0.0, False)],
        "site_id long, forecast_date string, threshold_km int, chance_pct double, reached boolean",
    )
    row = backtest.backtest_report(judged).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["precision"], row["recall"]) == (1, 1, 1, 1, 0.5, 0.5)
    assert row["brier"] == pytest.approx((0.04 + 0.36 + 0.64 + 0) / 4)


def test_prediction_table_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = golden.predictions(spark).withColumn("inputs", F.lit(None).cast(schemas.INPUTS))
    tables.write_predictions(rows, path)
    tables.write_predictions(rows.where("forecast_date = '2026-07-18'").withColumn("p100", F.lit(1.0)), path)
    back = tables.read_predictions(spark, path)
    assert back.count() == 35
    assert {(str(r["forecast_date"]), r["p100"]) for r in back.where("site_id = 3").collect()} == {
        ("2026-07-15", 55.0), ("2026-07-16", 60.0), ("2026-07-17", 65.0), ("2026-07-18", 1.0), ("2026-07-19", 62.0),
    }
    plan = back.where("forecast_date = '2026-07-18' AND site_id = 3").select("p100")._jdf.queryExecution().executedPlan().toString()
    assert "(forecast_date" in plan.split("PartitionFilters:")[1] and "EqualTo(site_id,3)" in plan
    assert "ReadSchema: struct<site_id:bigint,p100:double>" in plan


def test_table_with_another_column_is_refused(spark):
    with pytest.raises(ValueError, match="extra"):
        tables.conform(golden.sites(spark).withColumn("extra", F.lit(1)), schemas.SITE)


def test_zones(spark, tmp_path):
    root = str(tmp_path)
    raw = spark.createDataFrame([(1, 5.0, "feed", "2024-01-01"), (2, None, "feed", "2024-01-01"), (3, 6.0, " ", "2024-01-02"), (4, 7.0, "feed", "2024-01-02")], "id long, value double, source string, d string")
    zones.write_raw(raw, root, "flights", "b1")
    with pytest.raises(Exception, match="already exists"):
        zones.write_raw(raw, root, "flights", "b1")
    with pytest.raises(ValueError):
        zones.write_zone(raw, root, "raw", "flights", "d")
    interim = zones.to_interim(raw, "source", "value")
    assert sorted(r["quality_flag"] for r in interim.collect()) == ["missing", "ok", "ok", "ok"]
    done = zones.to_processed(interim, "km", "2024-02-01 00:00:00", "v1", "real")
    assert zones.write_zone(done, root, "processed", "flights", "d") == 1
    assert zones.write_zone(done.where("id = 4").withColumn("value", F.lit(8.0)), root, "processed", "flights", "d", "mended") == 2
    for version, value in ((None, 8.0), (2, 8.0), (1, 7.0)):
        back = zones.read_zone(spark, root, "processed", "flights", done.schema, "d", version)
        assert sorted((r["id"], r["value"], r["units"]) for r in back.collect()) == [(1, 5.0, "km"), (4, value, "km")]


def test_sums_beyond_a_long(spark):
    """Three values that each just fit a long."""
    total = spark.range(3).select(F.sum(backtest._whole(F.lit(9.0e12))).alias("t")).first()["t"]
    assert total == 27 * 10**18
    days = spark.range(4).selectExpr("cast(id % 2 as double) * 9e9 as cape_j_per_kg", "1.0D as temp_c", "0.0D as spread_c")
    scales = baselines.feature_scales(days).first()
    assert scales["scale_cape_j_per_kg"] == pytest.approx(4.5e9) and scales["scale_temp_c"] == 0


def test_name_of_two_launches_is_the_least(spark):
    flown = spark.createDataFrame([(1, "Sopot", 43.0, 23.0)], "flight_id long, launch_area string, start_latitude double, start_longitude double")
    launches = spark.createDataFrame([(8, 43.0, 23.0, 5.0)], "launch_id long, latitude double, longitude double, radius_km double")
    names = spark.createDataFrame([("sopot", 5), ("sopot", 3)], "alias string, launch_id long")
    assert [(r["launch_id"], r["method"]) for r in flights.assign_launches(flown, launches, names).collect()] == [(3, "name")]


def test_unreadable_optional_fields_are_issues(spark):
    names = schemas.FLIGHT_RECORD.names
    good = {n: "1" for n in names} | {"flight_date": "2024-01-02", "retrieved_at": "2024-01-02 03:04:05"}
    bad = [{"duration_min": "x"}, {"landing_latitude": "91"}, {"landing_longitude": "e"}, {"retrieved_at": "now-ish"}, {"duration_min": None}, {"duration_min": " "}]
    rows = [tuple((good | b)[n] for n in names) for b in bad]
    got = flights.ingest_flights(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))).collect()
    assert [[i["path"] for i in r["issues"]] for r in got] == [[k] for b in bad[:4] for k in b] + [[], []]


def test_levels_must_be_finite(spark):
    text = "1000 100 20 10 180 5\n900 1000 NaN 5 180 6\n800 2000 9 Infinity 180 7"
    got = weather.parse_soundings(spark.createDataFrame([(text,)], "raw_sounding_data string")).first()
    assert got["quality_flag"] == "partial" and len(got["levels"]) == 1

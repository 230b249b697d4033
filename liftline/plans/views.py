"""Spark views of the given tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.functions import metrics as M
from liftline.functions.calendar import iso_instant, local_date, shift_days
from liftline.operators.lookups import latest_runs
from liftline.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (key + 1).alias("id"),
        F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"),
        F.col("s_name").alias("name"),
        (F.lit(41.0) + (key % 50).cast("double") / 16).alias("latitude"),
        (F.lit(22.0) + (key % 90).cast("double") / 16).alias("longitude"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant and the number ``k`` of their JSON text ``{"k": n}``."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", "props",
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


_STATUS = {"click": "mock", "view": "manual", "signup": "baseline", "purchase": "real"}


def _status(event_type: Column) -> Column:
    pairs = [F.lit(v) for pair in _STATUS.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), event_type), F.lit("missing"))


def _inputs(k: Column, status: Column, run_at: Column) -> Column:
    """Seventeen inputs from ``k``; CAPE is missing for every seventh value of k."""
    reason = F.concat(F.lit("No input for k "), k.cast("string"))

    def plain(value: Column, kind: str = "double") -> Column:
        return M.input_metric(value, status, reason, kind)

    def real(factor: float, base: float) -> Column:
        return plain(k.cast("double") * factor + base)

    wind_type = "array<struct<altitudeMslM:double,directionDeg:double,speedKmh:double>>"
    winds = F.array(
        *[
            F.struct(
                F.lit(altitude).alias("altitudeMslM"),
                (k.cast("double") + 200.0).alias("directionDeg"),
                (k.cast("double") * 0.25 + speed).alias("speedKmh"),
            )
            for altitude, speed in ((1500.0, 16.0), (2500.0, 23.0))
        ]
    )
    cape_status = F.when(k % 7 == 0, "missing").otherwise(status)
    return F.struct(
        F.struct(F.lit("weather-source").alias("source"), F.lit("w1").alias("version")).alias("provenance"),
        iso_instant(run_at).alias("sourceRunAt"),
        real(0.25, 10.0).alias("surfaceTemperatureC"),
        real(0.125, 2.0).alias("dewPointC"),
        real(15.0, 800.0).alias("boundaryLayerHeightM"),
        real(0.03125, 0.5).alias("thermalStrengthMps"),
        real(0.5, 4.0).alias("boundaryLayerWindSpeedKmh"),
        real(2.0, 100.0).alias("boundaryLayerWindDirectionDeg"),
        plain(winds, wind_type).alias("windByAltitude"),
        real(0.0625, 1.0).alias("windShearMpsPerKm"),
        real(0.5, 30.0).alias("relativeHumidityPct"),
        M.input_metric(k.cast("double") * 12.5, cape_status, reason).alias("capeJPerKg"),
        real(0.5, 10.0).alias("cinJPerKg"),
        real(0.03125, 5.0).alias("lapseRateCPerKm"),
        real(0.5, 10.0).alias("lowCloudCoverPct"),
        real(0.5, 20.0).alias("totalCloudCoverPct"),
        real(0.0625, 0.0).alias("precipitationMm"),
        (plain(1020.0 - k.cast("double") * 0.25)).alias("surfacePressureHpa"),
        plain(
            F.when(k % 4 == 0, "absent").when(k % 4 == 1, "weak").when(k % 4 == 2, "moderate").otherwise("strong"),
            "string",
        ).alias("convergenceSignal"),
    )


def prediction_runs(spark: SparkSession, sf_dir: str, inputs: bool = False) -> DataFrame:
    """Append-only run log: several runs per key, some for unknown sites, a fifth missing."""
    k, value = F.col("k"), F.col("value")
    gone = F.col("event_type") == "error"
    capped = F.least(value, F.lit(100.0))
    status = _status(F.col("event_type"))
    level = F.when(k % 5 == 0, "high").when(k % 5 == 1, "medium").otherwise("low")
    drivers = F.array(F.lit("Thermal strength"), F.lit("Cloudbase estimate"), F.lit("Wind alignment"))
    return event_rows(spark, sf_dir).select(
        F.col("event_id").alias("run_id"),
        (F.col("user_id") + 1).alias("site_id"),
        shift_days(local_date(F.col("ts")), k % 4).alias("forecast_date"),
        F.col("ts").alias("generated_at"),
        F.struct(
            F.concat(F.lit("runs-"), F.col("event_type")).alias("source"),
            F.concat(F.lit("v"), (k % 4).cast("string")).alias("version"),
        ).alias("provenance"),
        status.alias("data_status"),
        M.confidence(level, F.concat(F.lit("Scored from "), F.col("event_type"), F.lit(" input."))).alias("confidence"),
        F.when(~gone, (1500 + 15 * k).cast("double")).alias("cloudbase_msl_m"),
        F.when(~gone, capped).alias("p100"),
        F.when(~gone, capped / 2).alias("p200"),
        F.when(~gone, capped / 5).alias("p300"),
        F.when(k % 3 == 0, "low").when(k % 3 == 1, "medium").otherwise("high").alias("od_risk"),
        *([_inputs(k, status, F.col("ts")).alias("inputs")] if inputs else []),
        F.slice(drivers, F.lit(1), k % 3 + 1).alias("top_drivers"),
        k.alias("k"),
    )


def predictions(spark: SparkSession, sf_dir: str, inputs: bool = False) -> DataFrame:
    return latest_runs(prediction_runs(spark, sf_dir, inputs))


def _slug(number: Column) -> Column:
    return F.concat(F.lit("supplier-"), F.lpad(number.cast("string"), 9, "0"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary requests: two slugs each, some repeated, some of unknown sites."""
    k = F.col("k")
    gap = F.when(k % 10 == 0, ",").otherwise(", ")
    return event_rows(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.to_date("ts").alias("request_date"),
        F.col("ts").alias("requested_at"),
        F.concat(_slug(F.col("user_id")), gap, _slug(k % 10)).alias("site_slugs"),
        _slug(F.col("user_id")).alias("slug"),
        "user_id",
        "k",
    )


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("k") % 6
    query = (
        F.when(kind == 0, F.concat(F.lit("?site="), _slug(F.col("user_id")), F.lit("&date=2024-01-15")))
        .when(kind == 1, "?site=unknown&date=2024-01-15")
        .when(kind == 2, "?site=supplier-000000001&site=supplier-000000002")
        .when(kind == 3, "?site=supplier-000000001&date=2024-02-30")
        .when(kind == 4, "?date=2024-01-15&site=supplier-000000003&x=1")
        .otherwise("")
    )
    return event_rows(spark, sf_dir).select(
        F.col("event_id").alias("view_id"),
        F.concat(F.lit("http://host/"), query).alias("url"),
        F.to_date("ts").alias("view_date"),
        "k",
    )


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("flight_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int")).alias("flight_date"),
        (F.col("o_custkey") % 15 + 1).alias("site_id"),
        (F.col("o_totalprice") / 1000).alias("distance_km"),
        F.col("o_custkey").alias("pilot_key"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").cast("timestamp").alias("retrieved_at"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several runs per site and date; ``run_age`` 1 is the newest."""
    valid = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 30).cast("int"))
    age = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") + 1).alias("site_id"),
        valid.alias("valid_date"),
        age.alias("run_age"),
        F.timestamp_seconds(
            F.unix_timestamp(valid.cast("timestamp")) - age.cast("long") * 6 * 3600
        ).alias("model_run_time"),
        F.col("l_quantity").alias("temp_c"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("dew_point_c"),
        (F.col("l_extendedprice") / 100).alias("cape_j_per_kg"),
        F.col("l_orderkey").alias("row_order"),
        F.col("l_partkey").alias("row_part"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
    )

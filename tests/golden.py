"""Seed catalog with five days of predictions around a fixed clock."""

from pyspark.sql import functions as F

from liftline.operators.scenarios import expand_scenarios
from liftline.sources.tables import seed_sites

TODAY = "2026-07-17"
NOW = "2026-07-17T12:00:00Z"

# Base profiles of the golden values: site, cloudbase, chances, risk.
PROFILES = [
    (1, 2300.0, 45.0, 20.0, 5.0, "medium"),
    (2, 2500.0, 60.0, 30.0, 10.0, "medium"),
    (3, 2400.0, 65.0, 35.0, 12.0, "medium"),
    (4, 2100.0, 40.0, 15.0, 3.0, "low"),
    (5, 2150.0, 42.0, 18.0, 4.0, "low"),
    (6, 2000.0, 35.0, 12.0, 2.0, "medium"),
    (7, 2200.0, 50.0, 22.0, 6.0, "low"),
]


def profiles(spark):
    return spark.createDataFrame(
        PROFILES, "site_id long, cloudbase_msl_m double, p100 double, p200 double, p300 double, od_risk string"
    ).withColumn("today", F.lit(TODAY).cast("date"))


def predictions(spark):
    rows = expand_scenarios(profiles(spark), "today")
    return rows.select(
        "site_id",
        F.col("scenario_date").alias("forecast_date"),
        F.lit(NOW).cast("timestamp").alias("generated_at"),
        F.struct(F.lit("test-source").alias("source"), F.lit("v2").alias("version")).alias("provenance"),
        F.lit("mock").alias("data_status"),
        F.struct(F.lit("low").alias("level"), F.lit("Test value.").alias("note")).alias("confidence"),
        "cloudbase_msl_m", "p100", "p200", "p300", "od_risk",
        F.lit(None).cast("string").alias("inputs"),
        F.array(F.lit("Thermal strength")).alias("top_drivers"),
    ).orderBy(F.rand(11))


def sites(spark):
    return seed_sites(spark)

"""Flight records: ingest, distance bands, duplicates, launches, quality profile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline import schemas
from liftline.functions import text as X
from liftline.functions.calendar import parse_date
from liftline.functions.issues import is_number, issue_list, unless
from liftline.operators.catchments import EARTH_RADIUS_KM, finest_cell, haversine_km, launches_near  # noqa: F401
from liftline.operators.keyed import skew_safe_join

DISTANCE_THRESHOLDS = (100, 200, 300)


def distance_flags(distance: Column) -> dict[str, Column]:
    """Nested flags; the boundary itself counts."""
    return {f"reached_{t}": distance >= t for t in DISTANCE_THRESHOLDS}


def distance_band(distance: Column) -> Column:
    band = F.when(distance.isNull(), F.lit(None).cast("string"))
    for threshold in sorted(DISTANCE_THRESHOLDS, reverse=True):
        band = band.when(distance >= threshold, f"{threshold}+")
    return band.otherwise("below 100")


def _blank_or(rule: Column, field: str) -> Column:
    return X.is_blank(F.col(field)) | F.coalesce(rule, F.lit(False))


def ingest_flights(raw: DataFrame) -> DataFrame:
    """Raw text columns of :data:`schemas.FLIGHT_RECORD` to typed ``record`` and ``issues``.

    A text that does not parse becomes null in ``record`` and an issue in ``issues``; a
    blank optional field is null without an issue, and landing points keep their bounds.
    use :func:`liftline.operators.rules.split_by_issues` for good rows and quarantine.
    """
    typed = {}
    for field in schemas.FLIGHT_RECORD:
        column = F.col(field.name)
        kind = field.dataType.simpleString()
        if kind == "date":
            typed[field.name] = parse_date(column)
        elif kind != "string":
            typed[field.name] = column.try_cast(kind)
        else:
            typed[field.name] = column
    record = F.struct(*[value.alias(name) for name, value in typed.items()])
    parsed = raw.withColumn("record", record)
    r = parsed["record"]
    issues = issue_list(
        unless(r["flight_id"] >= 1, "flight_id", fixed.WRONG_ID),
        unless(r["flight_date"].isNotNull(), "flight_date", fixed.DATE_REAL_MESSAGE),
        unless(~X.is_blank(r["source_url"]), "source_url", fixed.WRONG_NAME),
        unless(is_number(r["start_latitude"], -90, 90), "start_latitude", fixed.WRONG_NUMBER),
        unless(is_number(r["start_longitude"], -180, 180), "start_longitude", fixed.WRONG_NUMBER),
        unless(is_number(r["distance_km"], 0), "distance_km", fixed.WRONG_NUMBER),
        unless(_blank_or(is_number(r["duration_min"], 0), "duration_min"), "duration_min", fixed.WRONG_NUMBER),
        unless(_blank_or(is_number(r["landing_latitude"], -90, 90), "landing_latitude"), "landing_latitude", fixed.WRONG_NUMBER),
        unless(_blank_or(is_number(r["landing_longitude"], -180, 180), "landing_longitude"), "landing_longitude", fixed.WRONG_NUMBER),
        unless(_blank_or(r["retrieved_at"].isNotNull(), "retrieved_at"), "retrieved_at", fixed.WRONG_INSTANT),
    )
    return parsed.select("record", issues.alias("issues"))


DUPLICATE_KEY = ["site_id", "flight_date", "pilot_key"]
TOLERANCE_M = 100


def without_duplicates(flights: DataFrame, tolerance_m: int = TOLERANCE_M) -> DataFrame:
    """One row per flight: of records of one site, date and pilot the earliest retrieved.

    Records whose distances differ by up to ``tolerance_m`` metres are one flight, also by
    way of others between them; records without a distance are one flight of their own.
    ``copies`` counts the records, ``untraceable`` those without a source URL, ``least_km`` and
    ``largest_km`` are the ends of the chain.

    Distances are cut into bands as wide as the tolerance, so records of a band belong
    together, and two neighbouring bands if the gap between their ends is within it. Bands
    are aggregated in the input tasks and chained by a window over bands, never over records.
    """
    metres = F.round(F.col("distance_km") * 1000).cast("long")
    kept = F.struct("retrieved_at", "flight_id", "distance_km", "source_url")
    bands = (
        flights.withColumn("_m", metres)
        .groupBy(*DUPLICATE_KEY, F.floor(F.col("_m") / tolerance_m).alias("_band"))
        .agg(
            F.min(kept).alias("kept"),
            F.count("*").alias("copies"),
            F.count_if(F.col("source_url").isNull()).alias("untraceable"),
            F.min("_m").alias("_low"), F.max("_m").alias("_high"),
        )
    )
    along = Window.partitionBy(*DUPLICATE_KEY).orderBy(F.col("_band").asc_nulls_first())
    apart = F.coalesce(F.col("_low") - F.lag("_high").over(along) > tolerance_m, F.lit(True))
    chains = bands.withColumn("_apart", apart.cast("int")).withColumn("_chain", F.sum("_apart").over(along))
    return (
        chains.groupBy(*DUPLICATE_KEY, "_chain")
        .agg(
            F.min("kept").alias("kept"), F.sum("copies").alias("copies"), F.sum("untraceable").alias("untraceable"),
            (F.min("_low") / 1000).alias("least_km"), (F.max("_high") / 1000).alias("largest_km"),
        )
        .select(
            *DUPLICATE_KEY, "kept.flight_id", "kept.distance_km", "kept.source_url", "kept.retrieved_at",
            "copies", "untraceable", "least_km", "largest_km",
        )
    )


# --- Launch assignment -------------------------------------------------------------


def assign_launches(flights: DataFrame, launches: DataFrame, aliases: DataFrame) -> DataFrame:
    """``launch_id`` per flight: by its written name, else the nearest catchment.

    ``flights``: flight_id, launch_area, start_latitude, start_longitude;
    ``launches``: launch_id, latitude, longitude, radius_km; ``aliases``: alias in
    lower case, launch_id. A flight outside all catchments stays, without launch.
    The range join is an equality join on grid cells with an exact distance test; a cell has
    those launches only that can be the nearest in it (:func:`launches_near`).
    """
    # A name of several launches means the one with the least id.
    names = aliases.groupBy("alias").agg(F.min("launch_id").alias("alias_launch"))
    named = skew_safe_join(
        flights.withColumn("alias", F.lower(X.trim_all(F.col("launch_area")))), names, ["alias"]
    )
    placed = named.withColumns(finest_cell(F.col("start_latitude"), F.col("start_longitude")))
    # A written name decides by itself; only the other flights meet the grid.
    written = F.col("alias_launch").isNotNull()
    by_name = placed.where(written).select(
        "flight_id", "alias_launch", F.lit(None).cast("struct<_km:double,launch_id:bigint>").alias("near")
    )
    pairs = skew_safe_join(
        placed.where(~written), launches_near(flights, launches), ["cell_row", "cell_column"]
    )
    distance = haversine_km(
        F.col("start_latitude"), F.col("start_longitude"), F.col("_lat"), F.col("_lon")
    )
    # Rounded to a millimetre so that equal distances tie and the id decides.
    near = pairs.withColumn("_km", F.round(distance, 6)).withColumn(
        "_near", F.when(F.col("_km") <= F.col("radius_km"), F.struct("_km", "launch_id"))
    )
    by_place = near.groupBy("flight_id", "alias_launch").agg(F.min("_near").alias("near"))
    nearest = by_name.unionByName(by_place)
    method = (
        F.when(F.col("alias_launch").isNotNull(), "name")
        .when(F.col("near").isNotNull(), "radius")
        .otherwise("none")
    )
    scope = (
        F.when(F.col("near._km") <= 1, "launch")
        .when(F.col("near._km") <= 5, "cluster")
        .when(F.col("near").isNotNull(), "region")
    )
    return nearest.select(
        "flight_id",
        F.coalesce("alias_launch", "near.launch_id").alias("launch_id"),
        method.alias("method"),
        F.when(method == "radius", scope).alias("scope"),
        F.when(method == "radius", F.round("near._km", 3)).alias("distance_km"),
    )


# --- Quality profile ---------------------------------------------------------------


def quality_profile(
    rows: DataFrame, source: str, checks: Mapping[str, Column], thresholds: Mapping[str, float]
) -> DataFrame:
    """Rate of bad values per source and check, against its threshold, in one pass.

    ``checks`` maps a name to a condition that is true for a bad value.
    """
    counted = rows.groupBy(source).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(bad).alias(f"_{name}") for name, bad in checks.items()],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.col(f"_{name}").alias("n_bad"),
                (F.col(f"_{name}") / F.col("n_rows")).alias("rate"),
                F.lit(float(thresholds[name])).alias("threshold"),
            )
            for name in checks
        ]
    )
    return counted.select(source, "n_rows", F.inline(lines)).withColumn(
        "passed", F.col("rate") <= F.col("threshold")
    )

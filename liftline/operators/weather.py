"""Weather: sounding text, as-of join, derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline import schemas
from liftline.functions.issues import is_number
from liftline.operators.keyed import latest_per_key, skew_safe_join


def parse_soundings(raw: DataFrame, text: str = "raw_sounding_data") -> DataFrame:
    """Level lines (pressure, height, temp, dew point, direction, speed) to ``levels``.

    ``quality_flag`` is ok, partial (some lines could not be read, or hold a number that
    is not finite) or empty. The
    levels are read once, in a column of their own.
    """
    names = schemas.SOUNDING_LEVEL.names

    def level(tokens: Column) -> Column:
        values = [F.get(tokens, F.lit(i)).try_cast("double") for i in range(len(names))]
        complete = F.size(tokens) == len(names)
        for value in values:
            complete = complete & is_number(value)
        return F.when(complete, F.struct(*[v.alias(n) for v, n in zip(values, names)]))

    def tokens_of(line: Column) -> Column:
        return F.filter(F.split(line, " "), lambda token: token != "")

    # Tabs and carriage returns count as blanks; splits on one plain character are cheap.
    lines = F.split(F.translate(F.col(text), "\t\r", "  "), "\n")
    tokens = F.filter(F.transform(lines, tokens_of), lambda t: F.size(t) > 0)
    read = raw.withColumn("_levels", F.transform(tokens, level))
    compact = read.withColumn("levels", F.array_compact("_levels"))
    flag = (
        F.when(F.size("levels") == 0, "empty")
        .when(F.size("levels") < F.size("_levels"), "partial")
        .otherwise("ok")
    )
    return compact.withColumn("quality_flag", flag).drop("_levels")


def sounding_level_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per level in text order; a sounding without levels keeps one row."""
    return parsed.select(
        *keys, "quality_flag", F.posexplode_outer("levels").alias("pos", "level")
    ).select(*keys, "quality_flag", "pos", "level.*")


def with_level_features(rows: DataFrame, levels: str = "levels") -> DataFrame:
    """Features of a level array; null where two levels of different height are absent.

    Lapse rate: temperature drop from the lowest to the highest level per km. Wind
    shear: the largest vector difference between neighbouring levels per km. Spread:
    temperature minus dew point at the lowest level.
    """
    by_height = F.array_sort(
        F.transform(
            levels,
            lambda v: F.struct(
                v["height_m"].alias("height_m"), v["temp_c"].alias("temp_c"),
                v["dew_point_c"].alias("dew_point_c"),
                (v["wind_speed_mps"] * F.sin(F.radians(v["wind_direction_deg"]))).alias("u"),
                (v["wind_speed_mps"] * F.cos(F.radians(v["wind_direction_deg"]))).alias("v"),
            ),
        )
    )
    # Each step is a column that later steps use more than once.
    stepped = rows.withColumn("_sorted", by_height)
    ends = stepped.withColumns(
        {
            "_low": F.get("_sorted", F.lit(0)),
            "_high": F.try_element_at("_sorted", F.lit(-1)),
            "_above": F.slice("_sorted", F.lit(2), F.greatest(F.size("_sorted") - 1, F.lit(0))),
        }
    )

    def shear(above: Column, i: Column) -> Column:
        below = F.get("_sorted", i)
        rise = above["height_m"] - below["height_m"]
        gap = F.sqrt(F.pow(above["u"] - below["u"], 2) + F.pow(above["v"] - below["v"], 2))
        return F.when(rise > 0, gap / (rise / 1000))

    rise = (F.col("_high.height_m") - F.col("_low.height_m")) / 1000
    return ends.withColumns(
        {
            "lapse_rate_c_per_km": F.when(rise > 0, (F.col("_low.temp_c") - F.col("_high.temp_c")) / rise),
            "wind_shear_mps_per_km": F.array_max(F.transform("_above", shear)),
            "dew_point_spread_c": F.col("_low.temp_c") - F.col("_low.dew_point_c"),
        }
    ).drop("_sorted", "_low", "_high", "_above")


def cut_off(date: Column, lead_days: int = 0, zone: str = fixed.FORECAST_ZONE) -> Column:
    """Start of the date in the forecast zone, ``lead_days`` earlier, as an instant."""
    return F.to_utc_timestamp(F.date_add(date, -lead_days).cast("timestamp"), zone)


def weather_known_then(
    weather: DataFrame, newest_first: list[Column], lead_days: int = 0
) -> DataFrame:
    """Per site and valid date the latest run at or before the cut-off.

    The cut-off depends on the date alone, so the runs are reduced to one per site
    and date before any flight is joined.
    """
    in_time = weather.where(F.col("model_run_time") <= cut_off(F.col("valid_date"), lead_days))
    return latest_per_key(in_time, ["site_id", "valid_date"], newest_first)


def flights_with_weather(flights: DataFrame, known: DataFrame) -> DataFrame:
    """Left join: a flight without weather stays."""
    renamed = known.withColumnRenamed("valid_date", "flight_date")
    return skew_safe_join(flights, renamed, ["site_id", "flight_date"])


def cloudbase_m(temp: Column, dew_point: Column, elevation: Column) -> Column:
    """125 m per degree of spread above the site, never below zero; missing stays missing."""
    height = (temp - dew_point) * 125.0 + elevation
    return F.when(height.isNotNull(), F.greatest(height, F.lit(0.0)))

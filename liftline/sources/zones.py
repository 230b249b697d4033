"""Zones: immutable raw input, cleaned interim rows, versioned processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from liftline.functions.text import is_blank
from liftline.sources.snapshots import Snapshots

ZONES = ("raw", "interim", "processed")


def zone_path(root: str, zone: str, table: str) -> str:
    if zone not in ZONES:
        raise ValueError(f"Unknown zone {zone}.")
    return f"{root.rstrip('/')}/{zone}/{table}"


def to_interim(raw: DataFrame, source: str, value: str) -> DataFrame:
    """Adds the quality flag of ``value`` and keeps every row with its source."""
    flag = (
        F.when(F.col(value).isNull(), "missing")
        .when(F.isnan(F.col(value).cast("double")), "not a number")
        .otherwise("ok")
    )
    traceable = ~is_blank(F.col(source))
    return raw.withColumns({"quality_flag": flag, "traceable": traceable})


def to_processed(
    interim: DataFrame, units: str, run_time: str, version: str, status: str
) -> DataFrame:
    """Usable rows with units, run time, version and data status beside them."""
    usable = interim.where("quality_flag = 'ok' AND traceable")
    return usable.drop("quality_flag", "traceable").withColumns(
        {
            "units": F.lit(units),
            "run_time": F.lit(run_time).cast("timestamp"),
            "version": F.lit(version),
            "data_status": F.lit(status),
        }
    )


def write_raw(rows: DataFrame, root: str, table: str, batch: str) -> None:
    """A raw batch is written once; a second write of the same batch fails."""
    rows.write.mode("errorifexists").parquet(f"{zone_path(root, 'raw', table)}/batch={batch}")


def zone_table(
    spark: SparkSession, root: str, zone: str, table: str, schema: StructType, partition: str
) -> Snapshots:
    """A table of the interim or processed zone with its versions."""
    if zone == "raw":
        raise ValueError("Raw input is immutable; use write_raw.")
    return Snapshots(spark, zone_path(root, zone, table), schema, partition)


def write_zone(rows: DataFrame, root: str, zone: str, table: str, partition: str, note: str = "") -> int:
    """A new version, in which the partitions that ``rows`` carries are replaced by them.

    Earlier versions stay as they were; readers see the new one as a whole or not yet.
    """
    return zone_table(rows.sparkSession, root, zone, table, rows.schema, partition).replace(rows, note)


def read_zone(
    spark: SparkSession, root: str, zone: str, table: str, schema: StructType, partition: str, version: int | None = None
) -> DataFrame:
    """The latest version of a table, or the one asked for."""
    return zone_table(spark, root, zone, table, schema, partition).read(version)

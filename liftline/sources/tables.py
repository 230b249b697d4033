"""Site catalog and prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from liftline import fixed_values as fixed
from liftline import schemas
from liftline.sources.snapshots import Snapshots


def conform(rows: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the declared columns and types; an unknown or absent column is an error."""
    extra = sorted(set(rows.columns) - set(schema.names))
    absent = sorted(set(schema.names) - set(rows.columns))
    if extra or absent:
        raise ValueError(f"Unexpected columns {extra}, absent columns {absent}.")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def seed_sites(spark: SparkSession) -> DataFrame:
    """The seven seed sites; any other catalog can be used in their place."""
    return spark.createDataFrame(fixed.SEED_SITES, schemas.SITE)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SITE).parquet(path)


def prediction_table(spark: SparkSession, path: str) -> Snapshots:
    """One record per site and date, partitioned by date, with its earlier versions."""
    return Snapshots(spark, path, schemas.PREDICTION, "forecast_date")


def write_predictions(predictions: DataFrame, path: str) -> int:
    """Inserts by (site_id, forecast_date) and gives the version that then holds.

    The latest ``generated_at`` of a key wins, and of equal ones what is inserted last; all
    other keys of a date stay. Only dates that change are written.
    """
    table = prediction_table(predictions.sparkSession, path)
    return table.merge(predictions, ["site_id", "forecast_date"], [F.col("generated_at").desc_nulls_last()])


def read_predictions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The declared schema, with partition pruning on ``forecast_date``."""
    return prediction_table(spark, path).read(version)


def save_bucketed(predictions: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """A table dealt into ``buckets`` by site and date, sorted by date, for joins on that key.

    What is joined to it is shuffled to the buckets; the table itself is read in place. A
    site with many requests is spread over the buckets of its dates. Dates are not
    folders here, but files are sorted by them, so a filter on dates skips row groups.
    """
    rows = predictions.repartition(buckets, "site_id", "forecast_date")
    (
        rows.write.mode("errorifexists")
        .option("path", path)
        .bucketBy(buckets, "site_id", "forecast_date")
        .sortBy("forecast_date", "site_id")
        .format("parquet")
        .saveAsTable(name)
    )
    return predictions.sparkSession.table(name)

"""Filters, point reads and range reads over whole request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.functions.calendar import date_window
from liftline.operators.keyed import latest_per_key, skew_safe_join

PREDICTION_KEY = ["site_id", "forecast_date"]


def list_sites(sites: DataFrame) -> DataFrame:
    return sites.orderBy("id")


def sites_by_slug(lookups: DataFrame, sites: DataFrame) -> DataFrame:
    """Exact slug matches of ``lookups`` (with a ``slug`` column); no match, no row."""
    return lookups.join(sites, "slug")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run per site and date; equal times are decided by the run id."""
    return latest_per_key(
        runs, PREDICTION_KEY, [F.col("generated_at").desc(), F.col("run_id").desc()]
    )


def point_lookup(lookups: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions at exactly (site_id, forecast_date) of each lookup row."""
    return skew_safe_join(lookups, predictions, PREDICTION_KEY, "inner")


def point_lookup_in_place(lookups: DataFrame, bucketed: DataFrame) -> DataFrame:
    """:func:`point_lookup` in a table of :func:`liftline.sources.tables.save_bucketed`, which is not moved.

    The different keys of the lookups, reduced in the input tasks, are shuffled to the
    buckets; only the rows that are found go on to the lookups.
    """
    keys = lookups.select(*PREDICTION_KEY).distinct()
    found = bucketed.join(keys, PREDICTION_KEY, "left_semi")
    return skew_safe_join(lookups, found, PREDICTION_KEY, "inner")


def read_site_lists(requests: DataFrame, predictions: DataFrame, request_id: str) -> DataFrame:
    """Per request an ordered list ``site_ids`` for one ``forecast_date``.

    Matches keep the requested position, absent sites give no row and a repeated
    site gives one row per mention.
    """
    items = requests.select(
        request_id, "forecast_date", F.posexplode("site_ids").alias("pos", "site_id")
    )
    return point_lookup(items, predictions)


def read_date_ranges(ranges: DataFrame, predictions: DataFrame) -> DataFrame:
    """One site and an inclusive range ``from_date`` .. ``through_date`` per row.

    The range becomes its days, so the read is an equality join on site and date
    and a busy site is spread over its dates.
    """
    days = F.when(
        F.col("from_date") <= F.col("through_date"), F.sequence("from_date", "through_date")
    )
    slots = ranges.withColumn("forecast_date", F.explode(days))
    return point_lookup(slots, predictions)


def strip_slots(requests: DataFrame, today: str = "today") -> DataFrame:
    """Five calendar slots around ``today`` for each row, with ``pos`` 0..4."""
    window = date_window(F.col(today), 2, 2)
    return requests.select("*", F.posexplode(window).alias("pos", "forecast_date"))

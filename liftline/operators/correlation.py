"""Responses that do not belong to their request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline import fixed_values as fixed


def _violations(joined: DataFrame, resource: str, message) -> DataFrame:
    return joined.select(
        "request_id", F.lit(resource).alias("resource"), message.alias("message")
    ).where("message IS NOT NULL")


def days_violations(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Both sides have ``request_id`` and ``slug``."""
    returned = responses.select("request_id", F.col("slug").alias("returned_slug"))
    wrong = F.when(~F.col("returned_slug").eqNullSafe(F.col("slug")), fixed.OTHER_DAYS_SITE_MESSAGE)
    return _violations(requests.join(returned, "request_id"), "forecast-days", wrong)


def summaries_violations(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Request ``date``, ``slugs``; response ``date``, ``slugs``. Fewer slugs are allowed.

    The date is tested first, so a response gives at most one violation.
    """
    returned = responses.select(
        "request_id", F.col("date").alias("returned_date"), F.col("slugs").alias("returned_slugs")
    )
    unrequested = F.size(F.array_except("returned_slugs", "slugs")) > 0
    wrong = F.when(
        ~F.col("returned_date").eqNullSafe(F.col("date")), fixed.OTHER_SUMMARY_DATE_MESSAGE
    ).when(unrequested, fixed.OTHER_SUMMARY_SITE_MESSAGE)
    return _violations(requests.join(returned, "request_id"), "forecast-summaries", wrong)


def detail_violations(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Slug and date of the response both equal those of the request."""
    returned = responses.select(
        "request_id", F.col("slug").alias("returned_slug"), F.col("date").alias("returned_date")
    )
    same = F.col("returned_slug").eqNullSafe(F.col("slug")) & F.col("returned_date").eqNullSafe(
        F.col("date")
    )
    wrong = F.when(~same, fixed.OTHER_DETAIL_MESSAGE)
    return _violations(requests.join(returned, "request_id"), "forecast-detail", wrong)

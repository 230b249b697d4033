"""Read models: projections of predictions, and the joins that fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline.functions import metrics as M
from liftline.functions.calendar import iso_date, iso_instant
from liftline.operators.keyed import skew_safe_join
from liftline.operators.lookups import PREDICTION_KEY, strip_slots

NO_RUN_VALUE = "The forecast run gave no value."

_OUTPUT_SOURCE = {
    "cloudbaseMslM": ("cloudbase_msl_m", "double"),
    "chance100KmPct": ("p100", "double"),
    "chance200KmPct": ("p200", "double"),
    "chance300KmPct": ("p300", "double"),
    "overdevelopmentRisk": ("od_risk", "string"),
}


def metric_of(value: str, value_type: str = "double") -> Column:
    """One prediction column wrapped with the record's status and confidence."""
    return M.metric(
        F.col(value),
        F.col("data_status"),
        F.col("confidence.level"),
        F.col("confidence.note"),
        F.lit(NO_RUN_VALUE),
        value_type,
    )


def outputs() -> Column:
    """The five wrapped metrics of a prediction row."""
    return F.struct(
        *[metric_of(column, kind).alias(name) for name, (column, kind) in _OUTPUT_SOURCE.items()]
    )


def detailed_record() -> list[Column]:
    """Columns of the full document; the row needs ``slug`` beside the prediction."""
    return [
        F.col("site_id").alias("siteId"),
        F.col("slug").alias("siteSlug"),
        iso_date(F.col("forecast_date")).alias("forecastDate"),
        iso_instant(F.col("generated_at")).alias("generatedAt"),
        F.col("provenance"),
        outputs().alias("outputs"),
        F.col("inputs").alias("forecastInputs"),
        F.col("top_drivers").alias("topDrivers"),
    ]


def no_forecast_reason(slug: Column, date: Column) -> Column:
    return F.format_string(fixed.NO_FORECAST, slug, iso_date(date))


def available_summary() -> Column:
    return F.struct(
        F.lit("available").alias("availability"),
        F.col("site_id").alias("siteId"),
        F.col("slug").alias("siteSlug"),
        iso_date(F.col("forecast_date")).alias("forecastDate"),
        iso_instant(F.col("generated_at")).alias("generatedAt"),
        F.col("provenance"),
        outputs().alias("outputs"),
        F.lit(None).cast("string").alias("missingReason"),
    )


def missing_summary() -> Column:
    """The same struct type with only identity and reason filled."""
    gone = [
        F.lit(None).cast(kind).alias(name)
        for name, kind in (
            ("generatedAt", "string"),
            ("provenance", "struct<source:string,version:string>"),
        )
    ]
    return F.struct(
        F.lit(fixed.MISSING).alias("availability"),
        F.col("site_id").alias("siteId"),
        F.col("slug").alias("siteSlug"),
        iso_date(F.col("forecast_date")).alias("forecastDate"),
        *gone,
        F.when(F.lit(False), outputs()).alias("outputs"),
        no_forecast_reason(F.col("slug"), F.col("forecast_date")).alias("missingReason"),
    )


def day_metric() -> Column:
    """The 100+ km metric of a slot; a slot without prediction stays, as missing."""
    reason = F.format_string(
        fixed.NO_DAY_FORECAST, F.col("slug"), iso_date(F.col("forecast_date"))
    )
    return F.when(F.col("has_prediction"), metric_of("p100")).otherwise(
        M.missing_metric("double", reason)
    )


def _marked(predictions: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns a read model needs, so the scan stays narrow."""
    return predictions.select(*PREDICTION_KEY, *columns).withColumn("_found", F.lit(True))


def _with_presence(joined: DataFrame) -> DataFrame:
    return joined.withColumn("has_prediction", F.coalesce("_found", F.lit(False))).drop("_found")


_SUMMARY_COLUMNS = [
    "generated_at", "provenance", "data_status", "confidence", "cloudbase_msl_m",
    "p100", "p200", "p300", "od_risk",
]


def _request_items(requests: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per requested slug with its site id, null for an unknown slug."""
    items = requests.select(
        "request_id", "forecast_date", "slugs",
        F.posexplode_outer("slugs").alias("slug_pos", "slug"),
    )
    return items.join(sites.select("slug", F.col("id").alias("site_id")), "slug", "left")


def resolve_sites(requests: DataFrame, sites: DataFrame) -> DataFrame:
    """Requested slugs with their site, the request's unknown count and the site order.

    ``requests`` has ``request_id``, ``forecast_date`` and ``slugs``, as the rules
    give them for valid requests: at most seven slugs, which bounds the windows.
    """
    request = Window.partitionBy("request_id")
    return _request_items(requests, sites).withColumns(
        {
            "unknown_slugs": F.count_if(F.col("site_id").isNull()).over(request),
            "pos": F.row_number().over(request.orderBy("site_id")) - 1,
        }
    )


def unknown_requests(resolved: DataFrame) -> DataFrame:
    """Failed requests: the first unknown slug of each, in list order."""
    return (
        resolved.where("site_id IS NULL")
        .groupBy("request_id")
        .agg(F.min_by("slug", "slug_pos").alias("slug"), F.count("*").alias("unknown_slugs"))
        .withColumn("detail", F.format_string(fixed.NO_SITE, "slug"))
    )


def with_predictions(wanted: DataFrame, predictions: DataFrame) -> DataFrame:
    """Resolved sites with the columns of a summary and ``has_prediction``."""
    slots = wanted.select("request_id", "pos", "site_id", "slug", "forecast_date")
    return _with_presence(
        skew_safe_join(slots, _marked(predictions, _SUMMARY_COLUMNS), PREDICTION_KEY)
    )


def missing_sites(requests: DataFrame, sites: DataFrame, predictions: DataFrame) -> DataFrame:
    """The missing summaries of :func:`batched_summaries` alone; no outputs are built."""
    joined = with_predictions(resolve_sites(requests, sites).where("unknown_slugs = 0"), predictions)
    return joined.where("NOT has_prediction").select(
        "request_id", "pos", "site_id", "slug", "forecast_date", missing_summary().alias("summary")
    )


def batched_summaries(requests: DataFrame, sites: DataFrame, predictions: DataFrame) -> DataFrame:
    """Requested sites by one date: exactly one ``summary`` per requested site.

    ``pos`` is the place of the site in its response, by ascending site id whatever
    the order of the request. A request with any unknown slug gives no rows; see
    :func:`unknown_requests`.
    """
    wanted = resolve_sites(requests, sites).where("unknown_slugs = 0")
    return summaries_of(with_predictions(wanted, predictions))


def summaries_of(joined: DataFrame) -> DataFrame:
    summary = F.when(F.col("has_prediction"), available_summary()).otherwise(missing_summary())
    return joined.select(
        "request_id", "pos", "site_id", "slug", "forecast_date", summary.alias("summary")
    )


def day_preview(requests: DataFrame, sites: DataFrame, predictions: DataFrame) -> DataFrame:
    """Five slots per request (``request_id``, ``slug``, ``today``), gaps kept in place."""
    known = sites.select("slug", F.col("id").alias("site_id"))
    slots = strip_slots(requests.join(known, "slug"))
    joined = _with_presence(
        skew_safe_join(
            slots,
            _marked(predictions, ["data_status", "confidence", "p100"]),
            PREDICTION_KEY,
        )
    )
    return joined.select(
        "request_id", "site_id", "slug", "today", "pos", "forecast_date",
        day_metric().alias("chance100KmPct"),
    )


def detailed_lookup(requests: DataFrame, sites: DataFrame, predictions: DataFrame) -> DataFrame:
    """One outcome per request (``request_id``, ``slug``, ``forecast_date``).

    ``outcome`` is found, SITE_NOT_FOUND or FORECAST_NOT_FOUND; the site decides
    first. ``record`` is filled for found rows only.
    """
    known = sites.select("slug", F.col("id").alias("site_id"))
    resolved = requests.join(known, "slug", "left")
    joined = _with_presence(
        skew_safe_join(
            resolved,
            _marked(predictions, [*_SUMMARY_COLUMNS, "inputs", "top_drivers"]),
            PREDICTION_KEY,
        )
    )
    outcome = (
        F.when(F.col("site_id").isNull(), "SITE_NOT_FOUND")
        .when(~F.col("has_prediction"), "FORECAST_NOT_FOUND")
        .otherwise("found")
    )
    detail = F.when(
        F.col("site_id").isNull(), F.format_string(fixed.NO_SITE, F.col("slug"))
    ).when(~F.col("has_prediction"), no_forecast_reason(F.col("slug"), F.col("forecast_date")))
    return joined.select(
        "request_id", "slug", "forecast_date",
        outcome.alias("outcome"),
        detail.alias("detail"),
        F.when(F.col("has_prediction"), F.struct(*detailed_record())).alias("record"),
    )


def three_state_cards(cards: DataFrame, summaries: DataFrame) -> DataFrame:
    """Cards (``request_id``, ``slug``) by summaries: available, missing or omitted."""
    returned = summaries.select("request_id", "slug", "summary")
    joined = cards.join(returned, ["request_id", "slug"], "left")
    state = F.when(F.col("summary").isNull(), "omitted").otherwise(F.col("summary.availability"))
    return joined.withColumn("state", state)

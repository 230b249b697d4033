"""Response bodies of the sites, summaries and days routes and of problems, strictly read and written.

A body is judged in three steps, each only if the one before found nothing: the keys and
JSON types of every object, the rules of every field, the rules between items. All work is
inside the row of the body, so nothing is shuffled to read one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftline import fixed_values as fixed
from liftline import schemas
from liftline.functions import text as X
from liftline.functions.calendar import iso_date
from liftline.functions.issues import ISSUES_TYPE, issue, issue_list, issues_of_items, join_path, no_issues, unless
from liftline.operators import rules
from liftline.sources.json_records import MALFORMED, SCHEMA, json_object, json_scalar, metric_json, summary_json
from liftline.sources.shapes import NUMBER, either, has_shape, metric_shape, metrics_shape, object_shape, shape_of

# --- Sources ---------------------------------------------------------------------

_IDENTITY = {"availability": "STRING", "siteId": "BIGINT", "siteSlug": "STRING", "forecastDate": "STRING"}
_SUMMARY_SHAPE = either(
    object_shape(
        **_IDENTITY,
        generatedAt="STRING",
        provenance=shape_of(schemas.PROVENANCE),
        outputs=object_shape(**metrics_shape(schemas.OUTPUTS, schemas.OUTPUTS.names, True)),
    ),
    object_shape(**_IDENTITY, missingReason="STRING"),
)
_DAY_SHAPE = object_shape(forecastDate="STRING", chance100KmPct=metric_shape(NUMBER))


def _judge(
    rows: DataFrame,
    raw: str,
    schema: T.StructType,
    items: str,
    item_shape: str,
    field_issues: Callable[[Column], Column],
    between: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Adds ``record``, ``issues`` and ``failure_reason`` to rows with the text of a body.

    ``items`` names the one list of the body. ``record`` is filled for valid bodies only.
    Null and text that is no JSON are ``malformed-json``, with no issues.
    """
    top = object_shape(
        **{f.name: r"ARRAY<.*>" if f.name == items else shape_of(f.dataType) for f in schema}
    )
    body, listed = F.col("_body"), F.col("_items")
    read = rows.withColumn("_body", F.try_parse_json(raw)).withColumn(
        "_items", F.try_variant_get(body, f"$.{items}", "array<variant>")
    )
    of_items = issues_of_items(
        listed,
        lambda item, i: F.when(
            ~has_shape(item, item_shape),
            issue(join_path(items, i.cast("string")), fixed.WRONG_SHAPE),
        ),
    )
    shaped = F.when(~has_shape(body, top), issue("", fixed.WRONG_SHAPE)).otherwise(of_items)
    typed = F.when(F.size("_shape") == 0, F.try_variant_get(body, "$", schema.simpleString()))
    judged = (
        read.withColumn("_shape", F.when(body.isNotNull(), shaped).otherwise(no_issues()))
        .withColumn("_typed", typed)
        .withColumn("_fields", F.when(F.col("_typed").isNotNull(), field_issues(F.col("_typed"))))
    )
    clean = F.size("_fields") == 0
    last = F.when(clean, between(F.col("_typed"))) if between else F.lit(None).cast(ISSUES_TYPE)
    found = judged.withColumn("issues", issue_list(F.col("_shape"), F.col("_fields"), last))
    reason = F.when(body.isNull(), MALFORMED).when(F.size("issues") > 0, SCHEMA)
    return (
        found.withColumn("failure_reason", reason)
        .withColumn("record", F.when(F.col("failure_reason").isNull(), F.col("_typed")))
        .drop("_body", "_items", "_shape", "_typed", "_fields")
    )


def parse_sites_responses(rows: DataFrame, raw: str) -> DataFrame:
    """Bodies with a list of sites, which may be empty."""

    def fields(body: Column) -> Column:
        return issues_of_items(body["sites"], lambda site, i: rules.under(join_path("sites", i.cast("string")), rules.site_issues(site)))

    return _judge(rows, raw, schemas.SITES_RESPONSE, "sites", shape_of(schemas.SITE), fields)


def parse_summaries_responses(rows: DataFrame, raw: str) -> DataFrame:
    """Bodies with one to seven summaries of one date, by ascending site id."""

    def fields(body: Column) -> Column:
        return issue_list(
            rules.date_issue(body["forecastDate"], "forecastDate"),
            rules.summary_count_issue(body["summaries"]),
            issues_of_items(
                body["summaries"],
                lambda item, i: rules.under(join_path("summaries", i.cast("string")), rules.summary_issues(item)),
            ),
        )

    def between(body: Column) -> Column:
        # Blanks around a slug do not make it another slug.
        keyed = F.transform(
            body["summaries"], lambda item: item.withField("siteSlug", X.trim_all(item["siteSlug"]))
        )
        return rules.summary_batch_issues(keyed, body["forecastDate"])

    return _judge(rows, raw, schemas.SUMMARIES_RESPONSE, "summaries", _SUMMARY_SHAPE, fields, between)


def parse_days_responses(rows: DataFrame, raw: str) -> DataFrame:
    """Bodies with the five days around today."""

    def fields(body: Column) -> Column:
        return issue_list(
            unless(rules.site_id_rule(body["siteId"]), "siteId", fixed.WRONG_ID),
            rules.slug_issue(body["siteSlug"], "siteSlug"),
            rules.strip_frame_issues(body["timeZone"], body["todayDate"], body["days"]),
            issues_of_items(
                body["days"],
                lambda item, i: rules.under(join_path("days", i.cast("string")), rules.day_issues(item)),
            ),
        )

    def between(body: Column) -> Column:
        dates = F.transform(body["days"], lambda item: item["forecastDate"])
        return rules.strip_issues(body["timeZone"], body["todayDate"], dates)

    return _judge(rows, raw, schemas.DAYS_RESPONSE, "days", _DAY_SHAPE, fields, between)


def _problem_shape() -> str:
    """A problem with or without issues."""
    fields = {field.name: shape_of(field.dataType) for field in schemas.PROBLEM}
    without = {name: shape for name, shape in fields.items() if name != "issues"}
    return either(object_shape(**fields), object_shape(**without))


def parse_problems(rows: DataFrame, raw: str, namespace: str) -> DataFrame:
    """Problem bodies; ``issues`` are those found in the body, its own are in ``record``."""
    body, typed = F.col("_body"), F.col("_typed")
    read = rows.withColumn("_body", F.try_parse_json(raw)).withColumn(
        "_typed",
        F.when(has_shape(body, _problem_shape()), F.try_variant_get(body, "$", schemas.PROBLEM.simpleString())),
    )
    ruled = issue_list(
        rules.problem_issues(namespace, typed),
        rules.problem_envelope_issues(typed["requestId"], typed["issues"]),
    )
    found = (
        F.when(body.isNull(), no_issues()).when(typed.isNull(), issue("", fixed.WRONG_SHAPE)).otherwise(ruled)
    )
    judged = read.withColumn("issues", found)
    reason = F.when(body.isNull(), MALFORMED).when(F.size("issues") > 0, SCHEMA)
    return (
        judged.withColumn("failure_reason", reason)
        .withColumn("record", F.when(F.col("failure_reason").isNull(), typed))
        .drop("_body", "_typed")
    )


# --- Sinks -----------------------------------------------------------------------


def site_json(site: Column) -> Column:
    return json_object(*[(name, json_scalar(site[name])) for name in schemas.SITE.names])


def problem_json(problem: Column) -> Column:
    """The body of a problem; one without issues has no such key."""
    pairs = [(name, json_scalar(problem[name])) for name in schemas.PROBLEM.names]
    return F.when(problem["issues"].isNull(), json_object(*pairs[:-1])).otherwise(json_object(*pairs))


def _list(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def sites_response_json(sites: Column) -> Column:
    """The body for a list of sites in its order."""
    return json_object(("sites", _list(F.transform(sites, site_json))))


def _ordered(json: Column) -> Column:
    """The JSON texts of a group by ``pos``; a group has the few items of one request."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("pos"), json.alias("json"))))
    return F.transform(listed, lambda item: item["json"])


def summaries_responses(summaries: DataFrame) -> DataFrame:
    """``request_id`` and ``body`` from batched summaries, of which a request has at most seven."""
    grouped = summaries.groupBy("request_id", "forecast_date").agg(
        _ordered(summary_json(F.col("summary"))).alias("texts")
    )
    body = json_object(
        ("forecastDate", json_scalar(iso_date(F.col("forecast_date")))), ("summaries", _list(F.col("texts")))
    )
    return grouped.select("request_id", body.alias("body"))


def days_responses(preview: DataFrame) -> DataFrame:
    """``request_id`` and ``body`` from day previews, of which a request has five."""
    day = json_object(
        ("forecastDate", json_scalar(iso_date(F.col("forecast_date")))),
        ("chance100KmPct", metric_json(F.col("chance100KmPct"))),
    )
    grouped = preview.groupBy("request_id", "site_id", "slug", "today").agg(_ordered(day).alias("texts"))
    body = json_object(
        ("siteId", json_scalar(F.col("site_id"))),
        ("siteSlug", json_scalar(F.col("slug"))),
        ("timeZone", json_scalar(F.lit(fixed.FORECAST_ZONE))),
        ("todayDate", json_scalar(iso_date(F.col("today")))),
        ("days", _list(F.col("texts"))),
    )
    return grouped.select("request_id", body.alias("body"))

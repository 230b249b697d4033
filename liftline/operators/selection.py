"""Page-view selection over a log of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.functions.calendar import iso_date, parse_date
from liftline.operators.catalog import default_site


def _parameters(url: Column) -> Column:
    """Array of decoded (name, value) pairs in URL order.

    The text is cut by hand: the map form keeps one value per name, and repeated
    names are what has to be seen here.
    """
    without_fragment = F.split_part(url, F.lit("#"), F.lit(1))
    query = F.when(
        without_fragment.contains("?"), F.regexp_replace(without_fragment, r"^[^?]*\?", "")
    ).otherwise("")
    parts = F.filter(F.split(query, "&", -1), lambda part: part != "")

    def decoded(text: Column) -> Column:
        # A broken escape is kept as it stands instead of failing the job.
        return F.coalesce(F.try_url_decode(text), text)

    return F.transform(
        parts,
        lambda part: F.struct(
            decoded(F.split_part(part, F.lit("="), F.lit(1))).alias("name"),
            decoded(F.when(part.contains("="), F.regexp_replace(part, r"^[^=]*=", "")).otherwise("")).alias("value"),
        ),
    )


def _values(parameters: Column, name: str) -> Column:
    return F.transform(
        F.filter(parameters, lambda p: p["name"] == name), lambda p: p["value"]
    )


def _kind(values: Column) -> Column:
    return (
        F.when(F.size(values) == 0, "missing")
        .when(F.size(values) > 1, "repeated")
        .otherwise("single")
    )


def classify_parameters(views: DataFrame, url: str = "url") -> DataFrame:
    """``site_kind``: missing, repeated, single; ``date_kind``: also invalid, valid."""
    listed = views.withColumn("_p", _parameters(F.col(url)))
    listed = listed.withColumns({"_s": _values(F.col("_p"), "site"), "_d": _values(F.col("_p"), "date")})
    site_kind, date_kind = _kind(F.col("_s")), _kind(F.col("_d"))
    date_value = F.when(date_kind == "single", F.get("_d", F.lit(0)))
    return listed.withColumns(
        {
            "site_kind": site_kind,
            "site_value": F.when(site_kind == "single", F.get("_s", F.lit(0))),
            "date_kind": F.when(date_kind != "single", date_kind)
            .when(parse_date(date_value).isNull(), "invalid")
            .otherwise("valid"),
            "date_value": date_value,
            "query_text": F.array_join(
                F.transform("_p", lambda p: _pair(p["name"], p["value"])), "&"
            ),
        }
    ).drop("_p", "_s", "_d")


def _pair(name: Column, value: Column) -> Column:
    return F.concat(F.url_encode(name), F.lit("="), F.url_encode(value))


def requested_date() -> Column:
    """The date of the URL where it is valid: the selection while the strip is unknown."""
    return F.when(F.col("date_kind") == "valid", parse_date(F.col("date_value")))


def resolve_selection(classified: DataFrame, sites: DataFrame, today: str | None) -> DataFrame:
    """``selected_slug`` and ``selected_date`` of classified views.

    An unknown, missing or repeated site falls back to the default site. ``today``
    names the date column of a known strip, in which a valid date must lie; with
    no strip only a valid date of the URL is selected.
    """
    known = sites.select(F.col("slug").alias("site_value"), F.lit(True).alias("_known"))
    fallback = default_site(sites).select("slug").scalar()
    joined = classified.join(known, "site_value", "left")
    requested = requested_date()
    if today is None:
        date = requested
    else:
        within = requested.between(F.date_add(today, -2), F.date_add(today, 2))
        date = F.when(within, requested).otherwise(F.col(today))
    return joined.withColumns(
        {
            "selected_slug": F.when(F.col("_known"), F.col("site_value")).otherwise(fallback),
            "selected_date": date,
        }
    ).drop("_known")


def canonical_query(slug: Column, date: Column) -> Column:
    """``site=<slug>&date=<date>``; the date is left out when it is null."""
    return F.concat_ws(
        "&",
        _pair(F.lit("site"), slug),
        F.concat(F.lit("date="), iso_date(date)),
    )


def with_canonical_query(selected: DataFrame) -> DataFrame:
    """Adds the canonical text, both paths, and whether the URL differs from it."""
    text = canonical_query(F.col("selected_slug"), F.col("selected_date"))
    return selected.withColumn("canonical_query", text).withColumns(
        {
            "differs": F.col("query_text") != F.col("canonical_query"),
            "dashboard_path": F.concat(F.lit("/?"), F.col("canonical_query")),
            "detail_path": F.concat(F.lit("/forecast?"), F.col("canonical_query")),
        }
    )

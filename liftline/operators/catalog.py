"""Catalog questions: default site, box, duplicates, comparison sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline.operators.keyed import skew_safe_join, with_first_position

_SITE = ["id", "slug", "name", "latitude", "longitude"]


def default_site(sites: DataFrame) -> DataFrame:
    """The site with the least id, the slug deciding ties; no row for no sites."""
    first = F.min_by(F.struct(*_SITE), F.struct("id", "slug"))
    return sites.agg(first.alias("site")).where("site IS NOT NULL").select("site.*")


def bounding_box(sites: DataFrame) -> DataFrame:
    return sites.agg(
        F.min("latitude").alias("south"),
        F.min("longitude").alias("west"),
        F.max("latitude").alias("north"),
        F.max("longitude").alias("east"),
    )


def duplicate_rows(catalog: DataFrame) -> DataFrame:
    """Rows that repeat the id or slug of an earlier ``pos``; the id rule comes first."""
    # Both minima come from the catalog itself; each is joined once.
    first_slug = catalog.groupBy("slug").agg(F.min("pos").alias("_first_slug"))
    marked = with_first_position(catalog, ["id"], "pos", "_first_id")
    marked = skew_safe_join(marked, first_slug, ["slug"])
    message = F.when(
        F.col("pos") > F.col("_first_id"), F.format_string(fixed.DUPLICATE_ID_MESSAGE, F.col("id").cast("string"))
    ).when(F.col("pos") > F.col("_first_slug"), F.format_string(fixed.DUPLICATE_SLUG_MESSAGE, F.col("slug")))
    return marked.select("pos", "id", "slug", message.alias("message")).where("message IS NOT NULL")


def comparison_sites(sites: DataFrame) -> DataFrame:
    """The three sites after the first by (id, slug): a top-four read, no full sort."""
    return sites.orderBy("id", "slug").offset(1).limit(fixed.COMPARISON_SITE_COUNT)


def _comparison_array(sites: DataFrame) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("id", "slug")))
    return comparison_sites(sites).agg(listed.alias("others"))


def comparison_list(sites: DataFrame) -> Column:
    """The comparison sites as one array value of at most three structs."""
    return _comparison_array(sites).scalar()


def comparison_slugs(sites: DataFrame) -> Column:
    """Only the slugs of :func:`comparison_list`."""
    return _comparison_array(sites).select(F.transform("others", lambda s: s["slug"])).scalar()


def canonical_site_sets(selected: DataFrame, sites: DataFrame) -> DataFrame:
    """For each selected site (``id``, ``slug``): itself and the comparison sites.

    The selected row wins its id; the result ``slugs`` is ordered by (id, slug).
    All work is inside the row, because the comparison list has three entries.
    """
    listed = selected.withColumn("_others", comparison_list(sites))
    # A later list entry with an id seen before is dropped.
    others = F.filter(
        "_others",
        lambda s, i: (s["id"] != F.col("id"))
        & ~F.exists(F.slice("_others", 1, i), lambda earlier: earlier["id"] == s["id"]),
    )
    chosen = F.concat(F.array(F.struct("id", "slug")), others)
    return listed.withColumn(
        "slugs", F.transform(F.array_sort(chosen), lambda s: s["slug"])
    ).drop("_others")

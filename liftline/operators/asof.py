"""As-of join with an instant per row: the last version known at or before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.operators.keyed import skew_safe_join


def as_of_join(
    facts: DataFrame,
    versions: DataFrame,
    keys: list[str],
    at: str,
    known_at: str,
    values: list[str],
    newest_last: list[str],
    bucket_seconds: int = 3600,
) -> DataFrame:
    """``facts`` with ``found``, the struct of ``values`` of the last version of its key.

    A version counts from its ``known_at`` on, that instant included; of versions of one
    instant the one that is last in ``newest_last`` is taken. A row without a version, or
    with a null key or instant, has a null ``found``; no row of ``facts`` is lost or repeated.

    Time is cut into buckets. Inside a bucket rows and versions are scanned in order; where
    a bucket has no version up to a row, the last one of the nearest earlier bucket is carried
    forward. So a key is sorted bucket by bucket, and only one row per bucket is sorted as
    a whole: a key with a third of all rows is spread over its hours.
    """
    picked = F.struct(*newest_last, *[c for c in values if c not in newest_last])
    known = F.col(known_at).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    runs = versions.where(known).select(*keys, F.unix_micros(known_at).alias("_t"), picked.alias("_version"))
    row = F.struct(*[F.col(f"`{c}`") for c in facts.columns])
    usable = F.col(at).isNotNull()
    for key in keys:
        usable = usable & F.col(key).isNotNull()
    kind = runs.schema["_version"].dataType
    asked = facts.where(usable).select(*keys, F.unix_micros(at).alias("_t"), row.alias("_row"))

    bucket = F.floor(F.col("_t") / (bucket_seconds * 1_000_000))
    both = runs.unionByName(asked, allowMissingColumns=True).withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    # A version stands before the rows of its own instant.
    so_far = (
        Window.partitionBy(*part)
        .orderBy("_t", F.col("_row").isNotNull(), "_version")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = both.withColumn("_inside", F.last("_version", ignorenulls=True).over(so_far)).where("_row is not null")

    last = both.groupBy(*part).agg(
        F.max(F.when(F.col("_version").isNotNull(), F.struct("_t", "_version"))).alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*part, F.last("_last", ignorenulls=True).over(earlier)["_version"].alias("_carried"))
    joined = skew_safe_join(inside.select(*part, "_row", "_inside"), carried, part)

    def found(version: Column) -> Column:
        return F.when(version.isNotNull(), F.struct(*[version[c].alias(c) for c in values])).alias("found")

    some = joined.select("_row.*", found(F.coalesce("_inside", "_carried")))
    none = facts.where(~F.coalesce(usable, F.lit(False))).select("*", found(F.lit(None).cast(kind)))
    return some.unionByName(none)

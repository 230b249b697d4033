"""Keyed building blocks that stay even when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """Last row per key.

    ``row_number`` with ``= 1`` lets Spark keep one row per key in each input
    task before the shuffle, so a hot key reaches its reducer already reduced.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_k_per_key(
    rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per key with their rank, cut to ``k`` before the shuffle."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def best_with_ties(rows: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Rows per key whose ``value`` is among the ``k`` largest, with ``rank``; ties share one.

    A ranked window would bring all ties of a key into one task. Here the ``k`` best rows,
    which hold every value that counts, give its rank, and all rows with such a value are
    found by a join on key and value.
    """
    best = top_k_per_key(rows.select(*keys, value), keys, [F.col(value).desc()], k)
    ranks = best.groupBy(*keys, value).agg(F.min("rank").alias("rank"))
    return skew_safe_join(rows, ranks, [*keys, value], "inner")


def skew_safe_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join of ``facts`` in which a key may hold any share of the rows.

    A small lookup is broadcast after Spark's own size check. Otherwise both sides are
    shuffled once, and adaptive execution splits the partition of a hot key, or of null
    keys, by the sizes the shuffle has measured: as many pieces as it takes, each with a
    copy of the lookup rows. :func:`liftline.session.configure` keeps that on even where
    it costs another shuffle. Only rows of ``facts`` are split, so ``how`` must not ask
    for unmatched lookup rows.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"The rows of facts cannot be split in a {how} join.")
    return facts.join(lookup, keys, how)


def with_first_position(rows: DataFrame, keys: list[str], position: str, name: str) -> DataFrame:
    """Adds the least ``position`` among the rows with the same key.

    The minimum is pre-aggregated in the input tasks and joined back, so no task
    has to hold all rows of a key.
    """
    first = rows.groupBy(*keys).agg(F.min(position).alias(name))
    return skew_safe_join(rows, first, keys)


def with_previous_row(
    rows: DataFrame, keys: list[str], order: list[str], bucket: Column, values: list[str]
) -> DataFrame:
    """Adds ``previous``, the struct of ``values`` of the row before, per key.

    A plain ``lag`` would sort a whole key in one task. Here each key is cut into
    ordered buckets: ``lag`` inside a bucket, and the first row of a bucket takes
    the last row of the nearest earlier bucket of its key. ``bucket`` must not
    decrease along ``order``.
    """
    picked = F.struct(*order, *values)
    cut = rows.withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    inside = cut.withColumn(
        "_inside", F.lag(picked).over(Window.partitionBy(*part).orderBy(*order))
    )
    last = cut.groupBy(*part).agg(F.max(picked).alias("_last"))
    before = last.select(
        *part,
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_before"),
    )
    joined = inside.join(before, part, "left")
    return joined.withColumn("previous", F.coalesce("_inside", "_before")).drop(
        "_bucket", "_inside", "_before"
    )

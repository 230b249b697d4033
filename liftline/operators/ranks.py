"""Exact row numbers and equal-count bins without sorting a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.session import scratch_path


def numbered(rows: DataFrame, keys: list[str], order: list[str], number: str = "number", total: str = "total") -> DataFrame:
    """Adds the place of each row among those of its key, from 1, and their count.

    Rows are dealt out by ranges of keys and order, so that a key with any share of them
    covers many ranges. Each range is numbered by itself; the counts of the ranges before,
    one row per key and range, are added. ``order`` should tell the rows of a key apart:
    equal ones stay in one range, in no fixed order. The dealt rows are written to the
    shared scratch folder, since the ranges must be the same for counts and numbers.
    """
    path = scratch_path(rows.sparkSession, "ranges")
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*keys, *order]])
    ranged = ranged.withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    dealt = rows.sparkSession.read.schema(ranged.schema).parquet(path)

    part = [*keys, "_range"]
    counts = dealt.groupBy(*part).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(total)
    )
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    placed = dealt.withColumn("_place", inside).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in part]
    joined = placed.join(starts.alias("s"), same, "inner")
    return joined.select(
        *[F.col(f"r.`{c}`") for c in rows.columns],
        (F.col("r._place") + F.col("s._before")).cast("long").alias(number),
        F.col(f"s.{total}").cast("long").alias(total),
    )


def equal_count_bin(number: Column, total: Column, bins: int) -> Column:
    """The bin, from 1, of a row number; the first ones have a row more where it does not come out even."""
    size, rest = F.floor(total / bins), total % bins
    in_larger = number <= rest * (size + 1)
    larger = F.floor((number - 1) / (size + 1))
    smaller = rest + F.floor((number - 1 - rest * (size + 1)) / F.greatest(size, F.lit(1)))
    return (F.when(in_larger, larger).otherwise(smaller) + 1).cast("int")

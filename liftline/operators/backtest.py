"""Backtest of chances against flown distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.operators.flights import DISTANCE_THRESHOLDS
from liftline.operators.keyed import top_k_per_key
from liftline.operators.ranks import equal_count_bin, numbered

# Squared errors are summed in whole millionths of a squared percent, so that the
# sum does not depend on the order of rows. Decimals, as a long would be full after some
# hundred million rows.
_SCALE = 1_000_000


def _whole(value: Column) -> Column:
    return F.floor(value * _SCALE).cast("decimal(28,0)")


def judged(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """One row per prediction and threshold: chance in percent and what was flown.

    ``best`` has the longest flight per site and date; a date without flights counts
    as not reached. Missing chances are left out.
    """
    actual = best.withColumnRenamed("valid_date", "forecast_date")
    # One prediction per site and date, so no key can be hot.
    chances = predictions.select("site_id", "forecast_date", "p100", "p200", "p300")
    joined = chances.join(actual, ["site_id", "forecast_date"], "left")
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold_km"),
                F.col(f"p{t}").alias("chance_pct"),
                F.coalesce(F.col("best_km") >= t, F.lit(False)).alias("reached"),
            )
            for t in DISTANCE_THRESHOLDS
        ]
    )
    return joined.select("site_id", "forecast_date", F.inline(rows)).where("chance_pct IS NOT NULL")


def backtest_report(rows: DataFrame, alarm_pct: float = 50.0) -> DataFrame:
    """Counts, precision, recall and Brier score per threshold, with the example count."""
    said, reached = F.col("chance_pct") >= alarm_pct, F.col("reached")
    error = F.pow(F.col("chance_pct") - F.when(reached, 100.0).otherwise(0.0), 2)
    counted = rows.groupBy("threshold_km").agg(
        F.count("*").alias("n_examples"),
        F.count_if(said & reached).alias("tp"),
        F.count_if(said & ~reached).alias("fp"),
        F.count_if(~said & reached).alias("fn"),
        F.count_if(~said & ~reached).alias("tn"),
        F.sum(_whole(error)).alias("_error"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns(
        {
            "precision": F.when(tp + fp > 0, tp / (tp + fp)),
            "recall": F.when(tp + fn > 0, tp / (tp + fn)),
            "brier": F.col("_error").cast("double") / F.col("n_examples") / (10_000.0 * _SCALE),
        }
    ).drop("_error")


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Bins of equal count per threshold, by chance: their range, mean chance and share reached.

    Equal chances are told apart by site and date, so a bin is the one that sorting all rows
    of a threshold would give; see :func:`liftline.operators.ranks.numbered`.
    """
    placed = numbered(rows, ["threshold_km"], ["chance_pct", "site_id", "forecast_date"])
    bin_ = equal_count_bin(F.col("number"), F.col("total"), bins)
    counted = placed.groupBy("threshold_km", bin_.alias("bin")).agg(
        F.count("*").alias("n_examples"),
        F.count_if(F.col("reached")).alias("n_reached"),
        F.min("chance_pct").alias("least_chance_pct"),
        F.max("chance_pct").alias("largest_chance_pct"),
        F.sum(_whole(F.col("chance_pct"))).alias("_chance"),
    )
    return counted.withColumns(
        {
            "mean_chance_pct": F.col("_chance").cast("double") / F.col("n_examples") / _SCALE,
            "reached_share": F.col("n_reached") / F.col("n_examples"),
        }
    ).drop("_chance")


def error_examples(rows: DataFrame, k: int, alarm_pct: float = 50.0) -> DataFrame:
    """The ``k`` worst false positives and false negatives of each threshold."""
    said = F.col("chance_pct") >= alarm_pct
    wrong = rows.withColumn(
        "error",
        F.when(said & ~F.col("reached"), "false positive").when(~said & F.col("reached"), "false negative"),
    ).where("error IS NOT NULL")
    worst = F.when(said, -F.col("chance_pct")).otherwise(F.col("chance_pct"))
    return top_k_per_key(
        wrong, ["threshold_km", "error"], [worst, F.col("site_id"), F.col("forecast_date")], k
    )

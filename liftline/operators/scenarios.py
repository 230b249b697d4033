"""What-if rows: every profile under every day adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline.functions.calendar import shift_days
from liftline.functions.metrics import clamp_pct

_ADJUSTMENT = ["day_offset", "d_cloudbase", "d100", "d200", "d300"]


def expand_scenarios(
    profiles: DataFrame,
    today: str = "forecast_date",
    adjustments: Sequence[tuple[int, int, int, int, int]] = tuple(fixed.DAY_ADJUSTMENTS),
) -> DataFrame:
    """Chances move within 0..100, the cloudbase moves freely, the rest is copied.

    The adjustments are a parameter list, so each profile row is unfolded in place
    without a join or shuffle.
    """
    literal = F.array(
        *[
            F.struct(*[F.lit(v).alias(name) for name, v in zip(_ADJUSTMENT, row)])
            for row in adjustments
        ]
    )
    rows = profiles.withColumn("_a", F.explode(literal))
    return rows.withColumns(
        {
            "day_offset": F.col("_a.day_offset"),
            "scenario_date": shift_days(F.col(today), F.col("_a.day_offset")),
            "cloudbase_msl_m": F.col("cloudbase_msl_m") + F.col("_a.d_cloudbase"),
            "p100": clamp_pct(F.col("p100"), F.col("_a.d100")),
            "p200": clamp_pct(F.col("p200"), F.col("_a.d200")),
            "p300": clamp_pct(F.col("p300"), F.col("_a.d300")),
        }
    ).drop("_a")

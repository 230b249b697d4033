"""Baselines: cross-country probability, overdevelopment risk, similar days, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.operators.flights import DISTANCE_THRESHOLDS
from liftline.operators.keyed import best_with_ties, top_k_per_key

# --- Probability -----------------------------------------------------------------

# Fixed grid of feature buckets: least, greatest and count of inner buckets. Values
# outside fall into the two outer buckets, so there are at most 36 of them.
CAPE_GRID = (0.0, 800.0, 4)
SPREAD_GRID = (0.0, 4.0, 4)


def _bucket(value: Column, grid: tuple[float, float, int]) -> Column:
    least, greatest, count = grid
    return F.width_bucket(value, F.lit(least), F.lit(greatest), F.lit(count)).cast("int")


def best_distances(flights: DataFrame) -> DataFrame:
    """Longest flight per site and date."""
    return flights.groupBy("site_id", F.col("flight_date").alias("valid_date")).agg(
        F.max("distance_km").alias("best_km")
    )


def label_days(days: DataFrame, best: DataFrame) -> DataFrame:
    """Weather days with ``best_km``; a day without flights has none."""
    return days.join(best, ["site_id", "valid_date"], "left")


def bucketed(days: DataFrame) -> DataFrame:
    return days.withColumns(
        {
            "cape_bucket": _bucket(F.col("cape_j_per_kg"), CAPE_GRID),
            "spread_bucket": _bucket(F.col("temp_c") - F.col("dew_point_c"), SPREAD_GRID),
        }
    )


BUCKET = ["cape_bucket", "spread_bucket"]


def chances_from_earlier_days(days: DataFrame, best: DataFrame) -> DataFrame:
    """Probabilities per site and date from all days before it, of all sites.

    The share of strong days in the bucket with additive smoothing, and the example count.
    Days that reach a longer distance also reach the shorter ones, so the three
    probabilities are nested. A bucket without an earlier day gives no chance, few examples
    give low confidence. No day is counted for itself or for another of its date.

    Outcomes are counted per bucket and date first; running sums over the dates of a bucket
    then give the counts before each date. The grid has at most 49 buckets with the
    null ones, so this is a table of calendar size whatever the number of days.
    """
    labelled = bucketed(label_days(days, best))
    counts = labelled.groupBy(*BUCKET, "valid_date").agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("best_km") >= t).alias(f"_{t}") for t in DISTANCE_THRESHOLDS]
    )
    earlier = Window.partitionBy(*BUCKET).orderBy("valid_date").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*BUCKET, "valid_date", *[F.sum(c).over(earlier).alias(c) for c in ("_n", *[f"_{t}" for t in DISTANCE_THRESHOLDS])])
    n = F.col("h._n")
    chances = {f"p{t}": (F.col(f"h._{t}") + 1) / (n + 2) * 100 for t in DISTANCE_THRESHOLDS}
    level = F.when(n < 30, "low").when(n < 200, "medium").when(n.isNotNull(), "high")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}")) for c in BUCKET] + [F.col("d.valid_date") == F.col("h.valid_date")]
    joined = labelled.drop("best_km").alias("d").join(before.alias("h"), same, "left")
    return joined.select("d.*", n.alias("n_examples"), *[c.alias(name) for name, c in chances.items()], level.alias("confidence_level"))


# --- Overdevelopment -------------------------------------------------------------

# Driver: column, and the limits from which it scores one and two points.
RISK_SCORES = {
    "CAPE": ("cape_j_per_kg", 300.0, 600.0),
    "Cloud cover": ("cloud_cover_pct", 40.0, 70.0),
    "Humidity": ("humidity_pct", 80.0, 95.0),
    "Precipitation": ("precipitation_mm", 1.0, 3.0),
}


def overdevelopment() -> dict[str, Column]:
    """``od_risk`` from a score of 0 to 8 and its two main drivers.

    A missing value scores nothing; when all are missing there is no risk value.
    """
    scores = {
        name: F.when(F.col(c) >= two, 2).when(F.col(c) >= one, 1).otherwise(0)
        for name, (c, one, two) in RISK_SCORES.items()
    }
    total = sum(scores.values(), F.lit(0))
    known = F.coalesce(*[F.col(c) for c, _one, _two in RISK_SCORES.values()]).isNotNull()
    ranked = F.array_sort(
        F.filter(
            F.array(
                *[
                    F.struct((-score).alias("order"), F.lit(name).alias("name"))
                    for name, score in scores.items()
                ]
            ),
            lambda s: s["order"] < 0,
        )
    )
    return {
        "od_score": F.when(known, total),
        "od_risk": F.when(known, F.when(total <= 2, "low").when(total <= 4, "medium").otherwise("high")),
        "od_drivers": F.transform(F.slice(ranked, 1, 2), lambda s: s["name"]),
    }


# --- Ranking ---------------------------------------------------------------------


def best_days_per_site(predictions: DataFrame, reference: Column, k: int) -> DataFrame:
    """The ``k`` best dates of each site from the reference date on; ties share a rank."""
    upcoming = predictions.where((F.col("forecast_date") >= reference) & F.col("p100").isNotNull())
    return best_with_ties(upcoming, ["site_id"], "p100", k)


def best_sites_per_day(predictions: DataFrame, reference: Column, k: int) -> DataFrame:
    upcoming = predictions.where((F.col("forecast_date") >= reference) & F.col("p100").isNotNull())
    return best_with_ties(upcoming, ["forecast_date"], "p100", k)


# --- Similar days ----------------------------------------------------------------

FEATURES = ["temp_c", "spread_c", "cape_j_per_kg"]


def feature_scales(days: DataFrame) -> DataFrame:
    """One row: the standard deviation of each feature.

    Sums are taken over whole hundredths, so they do not depend on the order of rows.
    """
    sums = []
    for name in FEATURES:
        cents = F.round(F.col(name) * 100).cast("bigint")
        # Squares do not fit a long once there are tens of millions of days.
        exact = cents.cast("decimal(19,0)")
        sums += [F.sum(exact).alias(f"s_{name}"), F.sum((exact * exact).cast("decimal(28,0)")).alias(f"q_{name}")]
    total = days.agg(F.count("*").alias("n"), *sums)
    n = F.col("n").cast("double")

    def deviation(name: str) -> Column:
        s, q = (F.col(f"{p}_{name}").cast("double") for p in ("s", "q"))
        return F.sqrt((q - s * s / n) / n) / 100.0

    return total.select(*[deviation(name).alias(f"scale_{name}") for name in FEATURES])


def _scaled(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Features in deviations; a constant feature counts as equal everywhere."""
    complete = rows.dropna(subset=FEATURES)
    scale = scales.select(F.struct(*[f"scale_{name}" for name in FEATURES])).scalar()
    with_scale = complete.withColumn("_scale", scale)
    return with_scale.withColumns(
        {
            f"z_{name}": F.when(
                F.col(f"_scale.scale_{name}") > 0, F.col(name) / F.col(f"_scale.scale_{name}")
            ).otherwise(0.0)
            for name in FEATURES
        }
    ).drop("_scale")


def _gap(point: Column, low: Column, high: Column) -> Column:
    """Distance of a point to an interval, zero inside."""
    return F.greatest(low - point, point - high, F.lit(0.0))


def similar_days(
    upcoming: DataFrame, history: DataFrame, scales: DataFrame, k: int, cell: float = 1.0
) -> DataFrame:
    """Exactly the ``k`` nearest history days of the same site for each upcoming day.

    Both have site_id, valid_date and the features. Not all pairs are built: the
    history of a site is summarised by grid cells with their real bounds and counts.
    From the farthest corners of the cells follows a distance within which ``k`` days
    must lie; only cells whose nearest corner is within it are joined by equality.
    """
    zs = [f"z_{name}" for name in FEATURES]
    # Cells beyond 4 deviations are joined together, so a site has at most 9 ** 3.
    cell_columns = [
        F.least(F.greatest(F.floor(F.col(z) / cell), F.lit(-4)), F.lit(4)).cast("int").alias(f"c_{z}")
        for z in zs
    ]
    points = _scaled(history, scales).select("site_id", F.col("valid_date").alias("similar_date"), *zs, *cell_columns)
    cells = [f"c_{z}" for z in zs]
    bounds = [f(z).alias(f"{p}_{z}") for z in zs for p, f in (("lo", F.min), ("hi", F.max))]
    per_cell = points.groupBy("site_id", *cells).agg(F.count("*").alias("n"), *bounds)
    per_site = per_cell.groupBy("site_id").agg(
        F.collect_list(F.struct(*cells, "n", *[f"{p}_{z}" for z in zs for p in ("lo", "hi")])).alias("_cells")
    )
    asked = _scaled(upcoming, scales).select("site_id", "valid_date", *zs).join(per_site, "site_id")

    def least_distance(c: Column) -> Column:
        return sum((F.pow(_gap(F.col(z), c[f"lo_{z}"], c[f"hi_{z}"]), 2) for z in zs), F.lit(0.0))

    def greatest_distance(c: Column) -> Column:
        far = [F.greatest(F.abs(F.col(z) - c[f"lo_{z}"]), F.abs(F.col(z) - c[f"hi_{z}"])) for z in zs]
        return sum((F.pow(f, 2) for f in far), F.lit(0.0))

    measured = asked.withColumn(
        "_cells",
        F.array_sort(
            F.transform(
                "_cells",
                lambda c: F.struct(
                    greatest_distance(c).alias("far"), least_distance(c).alias("near"),
                    c["n"].alias("n"), *[c[name].alias(name) for name in cells],
                ),
            )
        ),
    )
    # Walk the cells by their far distance until k days are certain.
    reach = F.aggregate(
        "_cells",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("far")),
        lambda acc, c: F.when(acc["n"] >= k, acc).otherwise(
            F.struct((acc["n"] + c["n"]).alias("n"), c["far"].alias("far"))
        ),
        lambda acc: acc["far"],
    )
    # A hair of slack keeps rounding from shutting out a day on the border.
    needed = measured.withColumn("_reach", reach * (1 + 1e-9) + 1e-12).withColumn(
        "_cell", F.explode(F.filter("_cells", lambda c: c["near"] <= F.col("_reach")))
    )
    candidates = needed.select(
        "site_id", "valid_date", *[F.col(z).alias(f"q_{z}") for z in zs],
        *[F.col(f"_cell.{name}").alias(name) for name in cells],
    ).join(points, ["site_id", *cells])
    squared = sum((F.pow(F.col(f"q_{z}") - F.col(z), 2) for z in zs), F.lit(0.0))
    measured_pairs = candidates.select(
        "site_id", "valid_date", "similar_date", F.round(squared, 9).alias("distance_sq")
    )
    return top_k_per_key(
        measured_pairs, ["site_id", "valid_date"], [F.col("distance_sq"), F.col("similar_date")], k
    )

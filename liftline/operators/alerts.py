"""Alerts: thresholds and lead time, duplicates, watchlist, comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftline.functions.calendar import iso_date, local_date
from liftline.functions.text import integer_label
from liftline.operators.keyed import latest_per_key, skew_safe_join, with_previous_row
from liftline.operators.ranks import numbered
from liftline.sources.snapshots import Snapshots

# Chance column, distance in km, least chance in percent.
THRESHOLDS = (("p100", 100, 60.0), ("p200", 200, 40.0), ("p300", 300, 20.0))
ALERT_KEY = ["site_id", "forecast_date", "threshold_km"]


def _chances(runs: DataFrame, columns: Sequence[tuple[str, int]]) -> DataFrame:
    """Each run unfolded in place: a row per chance."""
    created = local_date(F.col("generated_at"))
    rows = F.array(*[F.struct(F.lit(km).alias("threshold_km"), F.col(c).alias("chance_pct")) for c, km in columns])
    return runs.select(
        "run_id", "site_id", "forecast_date", "generated_at", created.alias("created_date"), F.inline(rows)
    )


def _crossed(chances: DataFrame, lead_days: int) -> DataFrame:
    """Rows at or above ``threshold_pct`` at least ``lead_days`` ahead, with their text."""
    message = F.concat(
        integer_label(F.col("chance_pct")), F.lit("% chance of "), F.col("threshold_km").cast("string"),
        F.lit("+ km on "), iso_date(F.col("forecast_date")), F.lit(" at site "), F.col("site_id").cast("string"),
        F.lit("."),
    )
    return chances.where(
        (F.col("chance_pct") >= F.col("threshold_pct"))
        & (F.date_diff("forecast_date", "created_date") >= lead_days)
    ).withColumn("message", message)


def raise_alerts(
    runs: DataFrame, thresholds: Sequence[tuple[str, int, float]] = THRESHOLDS, lead_days: int = 1
) -> DataFrame:
    """One row per run and threshold that is crossed at least ``lead_days`` ahead.

    The thresholds are a parameter list; for a table of them see :func:`raise_alerts_by_table`.
    """
    least = {km: pct for _, km, pct in thresholds}
    pairs = [F.lit(v) for pair in least.items() for v in pair]
    chances = _chances(runs, [(c, km) for c, km, _ in thresholds])
    limit = F.element_at(F.create_map(*pairs), F.col("threshold_km"))
    unfolded = chances.withColumn("threshold_pct", limit)
    columns = ["run_id", "site_id", "forecast_date", "generated_at", "created_date", "threshold_km", "threshold_pct", "chance_pct", "message"]
    return _crossed(unfolded, lead_days).select(*columns)


# Days per bucket of the validity of thresholds.
VALIDITY_BUCKET_DAYS = 30


def thresholds_in_force(
    rows: DataFrame, thresholds: DataFrame, day: str, bucket_days: int = VALIDITY_BUCKET_DAYS
) -> DataFrame:
    """``rows`` with ``threshold_pct``, ``rule_id`` of the threshold that holds on ``day``.

    ``thresholds``: rule_id, site_id (null: every site), threshold_km, threshold_pct,
    valid_from, valid_to; the first day counts, the last does not, and null leaves that end
    open. Of several that hold, one for the site itself goes before one for every site, then
    the one that began last (an open begin is the earliest), then the larger rule_id. A row
    for which none holds is left out. ``rows`` need site_id, threshold_km, ``day`` and run_id.

    The interval join is an equality join: a threshold is repeated per bucket of days in
    which it holds, cut to the days that occur, and the exact days are tested afterwards.
    """
    bucket = lambda date: F.floor(F.unix_date(date) / bucket_days)
    span = rows.agg(F.min(bucket(F.col(day))).alias("low"), F.max(bucket(F.col(day))).alias("high")).first()
    first = F.greatest(F.coalesce(bucket(F.col("valid_from")), F.lit(span.low)), F.lit(span.low))
    last = F.least(F.coalesce(bucket(F.date_sub("valid_to", 1)), F.lit(span.high)), F.lit(span.high))
    held = thresholds.where("valid_from is null or valid_to is null or valid_from < valid_to")
    held = held.withColumn("_bucket", F.explode(F.when(first <= last, F.sequence(first, last))))
    order = F.struct(F.col("site_id").isNotNull().alias("own"), "valid_from", "rule_id").alias("_order")
    rule = F.struct("threshold_pct", "rule_id", "valid_from", "valid_to").alias("_rule")
    asked = rows.withColumn("_bucket", bucket(F.col(day)))
    of_site = held.where("site_id is not null").select("site_id", "threshold_km", "_bucket", order, rule)
    of_all = held.where("site_id is null").select("threshold_km", "_bucket", order, rule)
    found = skew_safe_join(asked, of_site, ["site_id", "threshold_km", "_bucket"], "inner").unionByName(
        skew_safe_join(asked, of_all, ["threshold_km", "_bucket"], "inner")
    )
    holds = F.coalesce(F.col("_rule.valid_from") <= F.col(day), F.lit(True)) & F.coalesce(
        F.col("_rule.valid_to") > F.col(day), F.lit(True)
    )
    best = latest_per_key(found.where(holds), ["run_id", "threshold_km"], [F.col("_order").desc()])
    return best.select(*rows.columns, "_rule.threshold_pct", "_rule.rule_id")


def raise_alerts_by_table(
    runs: DataFrame, thresholds: DataFrame, lead_days: int = 1, bucket_days: int = VALIDITY_BUCKET_DAYS
) -> DataFrame:
    """Alerts by the thresholds that hold on the day a run was made; see :func:`thresholds_in_force`."""
    chances = _chances(runs, [(c, km) for c, km, _ in THRESHOLDS])
    return _crossed(thresholds_in_force(chances, thresholds, "created_date", bucket_days), lead_days)


def new_alerts(candidates: DataFrame, sent: DataFrame, refresh_pct: float = 10.0) -> DataFrame:
    """Candidates that were not sent for their site, date and threshold.

    A sent alert is refreshed when the chance has risen by ``refresh_pct`` points over
    the latest one sent. Within the batch the earliest candidate of a key is kept.
    """
    last_sent = (
        sent.groupBy(*ALERT_KEY)
        .agg(F.max_by("chance_pct", F.struct("generated_at", "run_id")).alias("sent_pct"))
    )
    joined = skew_safe_join(candidates, last_sent, ALERT_KEY)
    open_ = joined.where(
        F.col("sent_pct").isNull() | (F.col("chance_pct") >= F.col("sent_pct") + refresh_pct)
    )
    first = latest_per_key(open_, ALERT_KEY, [F.col("generated_at").asc(), F.col("run_id").asc()])
    return first.withColumn("refreshed", F.col("sent_pct").isNotNull()).drop("sent_pct")


def watchlist(alerts: DataFrame) -> DataFrame:
    """Per creation day and site the open alerts with their lines, in date order.

    Alerts are unique per site, date and threshold, so the list of a site on one day
    is as long as its forecast horizon allows and never the whole day.
    """
    line = F.struct("forecast_date", "threshold_km", "message")
    lists = (
        alerts.where(F.col("forecast_date") >= F.col("created_date"))
        .groupBy("created_date", "site_id")
        .agg(F.sort_array(F.collect_list(line)).alias("lines"), F.count("*").alias("n_alerts"))
    )
    return lists.withColumn("text", F.array_join(F.transform("lines", lambda a: a["message"]), "\n"))


PAGE_LINES = 50


def daily_list(alerts: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """The open alerts of a creation day as one numbered list, in pages.

    Lines go by site, forecast date and threshold and are numbered through the whole day; a
    page has ``page_lines`` of them, so no row grows with the day. ``n_alerts`` and ``n_pages``
    are those of the day, ``first_number`` the number of the first line of the page.
    """
    open_ = alerts.where(F.col("forecast_date") >= F.col("created_date"))
    order = ["site_id", "forecast_date", "threshold_km", "run_id"]
    lines = numbered(open_, ["created_date"], order, "number", "n_alerts")
    page = (F.floor((F.col("number") - 1) / page_lines) + 1).cast("int")
    text = F.concat(F.col("number").cast("string"), F.lit(". "), F.col("message"))
    pages = lines.groupBy("created_date", page.alias("page"), "n_alerts").agg(
        F.min("number").alias("first_number"), F.sort_array(F.collect_list(F.struct("number", text.alias("text")))).alias("lines")
    )
    return pages.select(
        "created_date", "page", F.ceil(F.col("n_alerts") / page_lines).cast("int").alias("n_pages"), "n_alerts",
        "first_number", F.array_join("lines.text", "\n").alias("text"),
    )


# --- Sent alerts -----------------------------------------------------------------

SENT = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("site_id", T.LongType()),
        T.StructField("forecast_date", T.DateType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("created_date", T.DateType()),
        T.StructField("threshold_km", T.IntegerType()),
        T.StructField("threshold_pct", T.DoubleType()),
        T.StructField("chance_pct", T.DoubleType()),
        T.StructField("message", T.StringType()),
        T.StructField("refreshed", T.BooleanType()),
        T.StructField("batch", T.StringType()),
    ]
)


def sent_alerts(spark: SparkSession, path: str) -> Snapshots:
    """The latest alert sent per site, date and threshold, by forecast date."""
    return Snapshots(spark, path, SENT, "forecast_date")


def send_alerts(candidates: DataFrame, store: Snapshots, batch: str) -> DataFrame:
    """The new alerts of ``candidates`` against all sent before, which are then kept as sent.

    Of the store only the forecast dates of the batch are read, and only those that change
    are written, in one version that is named after the batch. A batch that was sent before,
    whole, is not sent again: its alerts are given once more as they were. If the job dies
    before the version is there, nothing counts as sent.
    """
    if batch not in store.notes().values():
        sent = store.read(only=store.values_in(candidates))
        fresh = new_alerts(candidates, sent).withColumn("batch", F.lit(batch)).select(*SENT.names)
        before = store.versions()
        version = store.merge(fresh, ALERT_KEY, [F.col("generated_at").desc(), F.col("run_id").desc()], batch)
        if version in before:  # nothing was new
            return store.spark.createDataFrame([], SENT)
    version = next(v for v, note in store.notes().items() if note == batch)
    return store.read(version).where(F.col("batch") == batch)


# --- Runs ------------------------------------------------------------------------

COMPARED = {
    "cloudbase_msl_m": "cloudbase",
    "p100": "c100",
    "p200": "c200",
    "p300": "c300",
    "od_risk": "risk",
}
UNCHANGED = "Unchanged"
NO_PREVIOUS = "No previous run"
NOT_COMPARABLE = "Unavailable"


def _change(column: str) -> Column:
    now, before = F.col(column), F.col(f"previous.{column}")
    moved = (
        F.concat(before, F.lit(" to "), now)
        if column == "od_risk"
        else F.concat(F.when(now > before, "+").otherwise("-"), integer_label(F.abs(now - before)))
    )
    return (
        F.when(F.col("previous").isNull(), NO_PREVIOUS)
        .when(now.isNull() | before.isNull(), NOT_COMPARABLE)
        .when(now == before, UNCHANGED)
        .otherwise(moved)
    )


def compare_runs(runs: DataFrame) -> DataFrame:
    """Each run against the run before for the same site and date.

    A run without values cannot be compared; the risk of such a run counts as none.
    """
    known = runs.withColumn("od_risk", F.when(F.col("data_status") != "missing", F.col("od_risk")))
    paired = with_previous_row(
        known.select("run_id", "site_id", "forecast_date", "generated_at", *COMPARED),
        ["site_id", "forecast_date"],
        ["generated_at", "run_id"],
        F.date_trunc("hour", F.col("generated_at")),
        list(COMPARED),
    )
    return paired.select(
        "run_id", "site_id", "forecast_date",
        F.col("previous.run_id").alias("previous_run_id"),
        *[_change(column).alias(f"{name}_change") for column, name in COMPARED.items()],
    )

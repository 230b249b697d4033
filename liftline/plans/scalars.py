"""Dates, labels and other column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline.functions import calendar as C
from liftline.functions import metrics as M
from liftline.functions import text as X
from liftline.plans import views as V
from liftline.plans.oracle_views import SOFIA, day, integer_text, number_text, with_views
from liftline.plans.registry import query


@query(
    "a49_local_date",
    f"SELECT event_id, {day(f'CAST({SOFIA} AS DATE)')} AS local_date FROM events",
)
def local_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.event_rows(spark, sf_dir).select("event_id", C.local_date(F.col("ts")).alias("local_date"))


@query(
    "a50_day_shift",
    with_views(
        ("ev",),
        f"""SELECT event_id, {day("CAST(ts AS DATE) + CAST(k - 50 AS INT)")} AS shifted,
  {day("CAST(ts AS DATE) - 365")} AS year_before FROM ev""",
    ),
)
def day_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.to_date("ts")
    return V.event_rows(spark, sf_dir).select(
        "event_id",
        C.shift_days(date, F.col("k") - 50).alias("shifted"),
        C.shift_days(date, -365).alias("year_before"),
    )


@query(
    "a51_date_window",
    f"""SELECT o_orderkey, {day("CAST(o_orderdate AS DATE)")} AS centre, {" || ',' || ".join(day(f"CAST(o_orderdate AS DATE) + ({n})") for n in range(-2, 3))} AS window_dates FROM orders""",
)
def window_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = F.to_date("o_orderdate")
    dates = F.transform(C.date_window(centre, 2, 2), C.iso_date)
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", centre.alias("centre"), F.array_join(dates, ",").alias("window_dates")
    )


@query(
    "a52_clamp",
    with_views(
        ("ev",),
        """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
  ELSE greatest(0::DOUBLE, least(100::DOUBLE, value + (k - 50))) END AS clamped FROM ev""",
    ),
)
def clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return V.event_rows(spark, sf_dir).select(
        "event_id", M.clamp_pct(value, F.col("k") - 50).alias("clamped")
    )


@query(
    "a53_date_labels",
    """SELECT o_orderkey, strftime(o_orderdate, '%d %b') AS day_month, strftime(o_orderdate, '%A') AS weekday,
  strftime(o_orderdate, '%Y') AS year_text, strftime(o_orderdate, '%A, %d %b') AS long_text FROM orders""",
)
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.to_date("o_orderdate")
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        C.day_month_label(date).alias("day_month"),
        C.weekday_label(date).alias("weekday"),
        C.year_label(date).alias("year_text"),
        C.long_label(date).alias("long_text"),
    )


# Every order day at a time of day that depends on the order, so both offsets
# and both clock changes of each year occur.
_INSTANT = "(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)))"


@query(
    "a54_generated_label",
    f"""SELECT o_orderkey, strftime(({_INSTANT} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Sofia', '%H:%M') || ' ' ||
  CASE WHEN date_diff('hour', {_INSTANT}, ({_INSTANT} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Sofia') = 3
    THEN 'EEST' ELSE 'EET' END AS generated_text FROM orders""",
)
def generated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    midnight = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    instant = F.timestamp_seconds(midnight + F.col("o_orderkey") % 1440 * 60)
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", C.generated_label(instant).alias("generated_text")
    )


@query(
    "a55_integer_label",
    f"""SELECT l_orderkey, l_linenumber, {integer_text('l_extendedprice')} AS price_text,
  {integer_text('l_quantity * 20.5')} AS half_text FROM lineitem""",
)
def integer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        X.integer_label(F.col("l_extendedprice")).alias("price_text"),
        X.integer_label(F.col("l_quantity") * 20.5).alias("half_text"),
    )


@query(
    "a56_capitalise",
    """SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name_text,
  upper(substr(lower(p_type), 1, 1)) || substr(lower(p_type), 2) AS type_text FROM part""",
)
def capitalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").select(
        "p_partkey",
        X.capitalise(F.col("p_name")).alias("name_text"),
        X.capitalise(F.lower("p_type")).alias("type_text"),
    )


def _sql_case(column: str, labels: dict) -> str:
    def shown(value: object) -> str:
        return str(value) if isinstance(value, int) else f"'{value}'"

    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {shown(v)}" for k, v in labels.items()) + " END"


# One row in ten has no common status or level, so all labels are used.
_STATUS_SQL = "CASE WHEN k % 10 = 9 THEN 'mixed' ELSE data_status END"
_LEVEL_SQL = "CASE WHEN k % 10 = 9 THEN 'mixed' WHEN data_status = 'missing' THEN 'unavailable' ELSE confidence_level END"


def _display(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.col("k") % 10 == 9
    return V.prediction_runs(spark, sf_dir).select(
        "run_id",
        F.when(mixed, "mixed").otherwise(F.col("data_status")).alias("status"),
        F.when(mixed, "mixed")
        .when(F.col("data_status") == fixed.MISSING, "unavailable")
        .otherwise(F.col("confidence.level"))
        .alias("level"),
    )


@query(
    "a57_labels",
    with_views(
        ("runs",),
        f"""SELECT run_id, {_sql_case(f'({_STATUS_SQL})', fixed.STATUS_LABELS)} AS status_text,
  {_sql_case(f'({_LEVEL_SQL})', fixed.CONFIDENCE_LABELS)} AS confidence_text FROM runs""",
    ),
)
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _display(spark, sf_dir).select(
        "run_id",
        X.status_label(F.col("status")).alias("status_text"),
        X.confidence_label(F.col("level")).alias("confidence_text"),
    )


@query(
    "a58_confidence_segments",
    with_views(
        ("runs",),
        f"SELECT run_id, {_sql_case(f'({_LEVEL_SQL})', fixed.CONFIDENCE_SEGMENTS)} AS segments FROM runs",
    ),
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _display(spark, sf_dir).select(
        "run_id", X.confidence_segments(F.col("level")).alias("segments")
    )


@query(
    "a59_wind_profile_text",
    with_views(
        ("ev",),
        f"""SELECT event_id, {integer_text('1000 + k * 10.5')} || ' m: ' || {number_text('value')} || ' km/h · ' ||
  {integer_text('2000 + k * 10.5')} || ' m: ' || {number_text('k * 0.25::DOUBLE')} || ' km/h' AS profile FROM ev""",
    ),
)
def wind_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    def level(base: float, speed) -> object:
        return F.struct(
            (F.lit(base) + F.col("k") * 10.5).alias("altitudeMslM"),
            F.lit(0.0).alias("directionDeg"),
            speed.alias("speedKmh"),
        )

    levels = F.array(level(1000.0, F.col("value")), level(2000.0, F.col("k") * F.lit(0.25)))
    return V.event_rows(spark, sf_dir).select("event_id", X.wind_profile_text(levels).alias("profile"))

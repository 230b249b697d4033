"""Golden values of dates, labels and numbers."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from liftline.functions import calendar as C
from liftline.functions import metrics as M
from liftline.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def instant(text):
    return F.lit(text).cast("timestamp")


def date(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(
    "utc, expected",
    [
        ("2026-12-31T22:30:00Z", "2027-01-01"),
        ("2024-03-30T21:59:00Z", "2024-03-30"),
        ("2024-03-30T22:00:00Z", "2024-03-31"),
        ("2024-03-31T20:59:59Z", "2024-03-31"),
        ("2024-03-31T21:00:00Z", "2024-04-01"),
        ("2024-10-27T21:59:00Z", "2024-10-27"),
        ("2024-10-27T22:00:00Z", "2024-10-28"),
    ],
)
def test_local_date(spark, utc, expected):
    assert str(one(spark, C.local_date(instant(utc)))) == expected


@pytest.mark.parametrize(
    "start, days, expected",
    [("2028-02-28", 1, "2028-02-29"), ("2026-12-31", 1, "2027-01-01"), ("2027-01-01", -1, "2026-12-31")],
)
def test_day_shift(spark, start, days, expected):
    assert str(one(spark, C.shift_days(date(start), days))) == expected


def test_date_window(spark):
    window = one(spark, C.date_window(date("2026-07-17"), 2, 2))
    assert [str(d) for d in window] == [f"2026-07-{n}" for n in range(15, 20)]


@pytest.mark.parametrize(
    "text, valid",
    [
        ("2026-02-28", True), ("2028-02-29", True), ("2026-02-30", False), ("2026-2-3", False),
        ("0050-01-01", False), ("0100-01-01", True), ("2026-01-01\n", False), ("2026-13-01", False),
        ("2026-01-01T00:00", False), ("", False), (None, False), ("1900-02-29", False),
    ],
)
def test_calendar_date_rule(spark, text, valid):
    assert (one(spark, C.parse_date(F.lit(text).cast("string"))) is not None) is valid


@pytest.mark.parametrize(
    "text, valid",
    [
        ("2026-07-17T12:00:00.000Z", True), ("2026-07-17T12:00Z", True), ("2026-07-17T12:00:00", False),
        ("2026-07-17T12:00:00+02:00", False), ("2026-02-30T12:00:00Z", False), ("2026-07-17T25:00:00Z", False),
    ],
)
def test_instant_rule(spark, text, valid):
    assert one(spark, C.is_instant(F.lit(text))) is valid


def test_date_labels(spark):
    assert one(spark, C.long_label(date("2026-07-20"))) == "Monday, 20 Jul"
    assert one(spark, C.long_label(date("2026-01-01"))) == "Thursday, 01 Jan"
    assert one(spark, C.day_month_label(date("2026-12-31"))) == "31 Dec"
    assert one(spark, C.weekday_label(date("2026-12-31"))) == "Thursday"
    assert one(spark, C.year_label(date("2026-12-31"))) == "2026"


def test_generated_label(spark):
    assert one(spark, C.generated_label(instant("2026-07-17T20:00:00Z"))) == "23:00 EEST"
    assert one(spark, C.generated_label(instant("2026-01-17T20:00:00Z"))) == "22:00 EET"


@pytest.mark.parametrize("value, expected", [(2400.0, "2,400"), (2400.5, "2,401"), (0.5, "1"), (999.5, "1,000"), (0.0, "0")])
def test_integer_label(spark, value, expected):
    assert one(spark, X.integer_label(F.lit(value))) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        (65.0, "65"), (28.2, "28.2"), (0.0, "0"), (-0.0, "0"), (-4.5, "-4.5"), (12345678.25, "12345678.25"),
        (10000000.0, "10000000"), (0.0005, "0.0005"), (1e-7, "1e-7"), (1e21, "1e+21"), (100.0, "100"),
    ],
)
def test_number_text(spark, value, expected):
    assert one(spark, X.number_text(F.lit(value))) == expected


def test_labels(spark):
    assert one(spark, X.capitalise(F.lit("medium"))) == "Medium"
    assert one(spark, X.status_label(F.lit("missing"))) == "Unavailable"
    assert one(spark, X.status_label(F.lit("mixed"))) == "Mixed data"
    assert one(spark, X.confidence_label(F.lit("unavailable"))) == "Confidence unavailable"
    assert [one(spark, X.confidence_segments(F.lit(v))) for v in ("high", "medium", "low", "mixed")] == [3, 2, 1, 0]


@pytest.mark.parametrize("text", ["\tsopot ", " sopot ", "﻿sopot\r\n"])
def test_trim_takes_all_white_space(spark, text):
    assert one(spark, X.trim_all(F.lit(text))) == "sopot"


def test_clamp_keeps_missing_missing(spark):
    assert one(spark, M.clamp_pct(F.lit(98.0), 8)) == 100.0
    assert one(spark, M.clamp_pct(F.lit(3.0), -10)) == 0.0
    assert one(spark, M.clamp_pct(F.lit(None).cast("double"), 8)) is None


def test_year_changes_are_real_dates(spark):
    assert one(spark, C.parse_date(F.lit("2026-12-31"))) == dt.date(2026, 12, 31)


def test_number_text_keeps_all_digits(spark):
    values = [1.2345678901234567e-4, 3.3333333333333337e-6, 1e-6, 9.999999999999999e-4, 12345678.125, 1e20, 1.5e-3]
    want = [format(Decimal(repr(v)).normalize(), "f") for v in values]
    assert want[0] == "0.00012345678901234567" and want[2] == "0.000001"
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in rows.select(X.number_text(F.col("x"))).collect()] == want

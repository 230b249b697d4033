"""Calendar dates and instants in the forecast zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftline import fixed_values as fixed


def local_date(instant: Column, zone: str = fixed.FORECAST_ZONE) -> Column:
    """UTC instant to the calendar date in ``zone``."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def shift_days(date: Column, days: Column | int) -> Column:
    """Calendar days, not steps of 24 hours."""
    return F.date_add(date, days)


def date_window(centre: Column, before: int, after: int) -> Column:
    """Inclusive array of dates around ``centre``."""
    return F.sequence(F.date_add(centre, -before), F.date_add(centre, after))


def is_date_shape(text: Column) -> Column:
    return F.coalesce(text.rlike(fixed.DATE_PATTERN), F.lit(False))


def parse_date(text: Column) -> Column:
    """Strict ``YYYY-MM-DD``; null unless it is a real day from year 100 on."""
    return F.when(
        text.rlike(fixed.DATE_PATTERN) & ~text.startswith("00"),
        F.try_to_date(text, "yyyy-MM-dd"),
    )


def is_instant(text: Column) -> Column:
    return F.coalesce(
        text.rlike(fixed.INSTANT_PATTERN) & parse_date(F.substring(text, 1, 10)).isNotNull(),
        F.lit(False),
    )


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def iso_instant(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_month_label(date: Column) -> Column:
    return F.date_format(date, "dd MMM")


def weekday_label(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def year_label(date: Column) -> Column:
    return F.date_format(date, "y")


def long_label(date: Column) -> Column:
    return F.date_format(date, "EEEE, dd MMM")


def generated_label(instant: Column, zone: str = fixed.FORECAST_ZONE) -> Column:
    """``HH:mm EET`` or ``HH:mm EEST``, the zone name taken from the offset."""
    local = F.from_utc_timestamp(instant, zone)
    offset = F.unix_timestamp(local) - F.unix_timestamp(instant)
    name = F.when(offset == 3 * 3600, "EEST").otherwise("EET")
    return F.concat(F.date_format(local, "HH:mm"), F.lit(" "), name)

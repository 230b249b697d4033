"""Text of numbers, labels and profiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftline import fixed_values as fixed

# All white space, not only the space that trim() strips.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.length(trim_all(text)) == 0, F.lit(True))


def is_slug(text: Column) -> Column:
    return F.coalesce(
        text.rlike(fixed.SLUG_PATTERN) & (F.length(text) <= fixed.SLUG_MAX_LENGTH),
        F.lit(False),
    )


def number_text(value: Column) -> Column:
    """Shortest plain text of a double: ``65`` and ``28.2``, not ``65.0`` or ``1.0E7``."""
    raw = value.cast("string")
    size = F.abs(value)
    exponent = F.lower(F.regexp_replace(raw, r"\.0E", "E"))
    # Large numbers have few places behind the point and small ones none before it, so
    # either type holds all 17 digits of a double.
    places = F.when(size < 1, raw.try_cast("decimal(38,30)").cast("string")).otherwise(
        raw.try_cast("decimal(38,14)").cast("string")
    )
    plain = F.regexp_replace(places, r"\.?0+\z", "")
    return (
        F.when(value == 0, "0")
        .when(size >= 1e21, F.regexp_replace(exponent, "e", "e+"))
        .when(size < 1e-6, exponent)
        .when(raw.contains("E"), plain)
        .otherwise(F.regexp_replace(raw, r"\.0\z", ""))
    )


def integer_label(value: Column) -> Column:
    """Grouped whole number; a half rounds away from zero."""
    return F.format_number(F.round(value, 0), 0)


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def _label(key: Column, labels: Mapping[str, object]) -> Column:
    pairs = [F.lit(item) for pair in labels.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def status_label(status: Column) -> Column:
    return _label(status, fixed.STATUS_LABELS)


def confidence_label(level: Column) -> Column:
    return _label(level, fixed.CONFIDENCE_LABELS)


def confidence_segments(level: Column) -> Column:
    return _label(level, fixed.CONFIDENCE_SEGMENTS)


def wind_profile_text(levels: Column) -> Column:
    """``1,500 m: 18 km/h · 2,500 m: 23 km/h`` in array order."""
    return F.array_join(
        F.transform(
            levels,
            lambda w: F.concat(
                integer_label(w["altitudeMslM"]),
                F.lit(" m: "),
                number_text(w["speedKmh"]),
                F.lit(" km/h"),
            ),
        ),
        " · ",
    )

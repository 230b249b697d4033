"""Metrics: a value with status and confidence, or an explicit missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftline import fixed_values as fixed


def confidence(level: Column, note: Column) -> Column:
    return F.struct(level.alias("level"), note.alias("note"))


def missing_metric(value_type: str, reason: Column) -> Column:
    """Null value, status ``missing``, null confidence and a reason."""
    return F.struct(
        F.lit(None).cast(value_type).alias("value"),
        F.lit(fixed.MISSING).alias("dataStatus"),
        F.lit(None).cast("struct<level:string,note:string>").alias("confidence"),
        reason.alias("missingReason"),
    )


def metric(value: Column, status: Column, level: Column, note: Column, reason: Column,
           value_type: str = "double") -> Column:
    """Wrap one value with the record-level status and confidence."""
    available = F.struct(
        value.cast(value_type).alias("value"),
        status.alias("dataStatus"),
        confidence(level, note).alias("confidence"),
        F.lit(None).cast("string").alias("missingReason"),
    )
    return F.when(status == fixed.MISSING, missing_metric(value_type, reason)).otherwise(available)


def input_metric(value: Column, status: Column, reason: Column, value_type: str = "double") -> Column:
    """An input metric carries no confidence."""
    gone = status == fixed.MISSING
    return F.struct(
        F.when(~gone, value).cast(value_type).alias("value"),
        status.alias("dataStatus"),
        F.when(gone, reason).alias("missingReason"),
    )


def clamp_pct(value: Column, delta: Column | int = 0) -> Column:
    """``value + delta`` kept within 0..100; a missing value stays missing."""
    moved = value + delta
    return F.when(moved.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), moved)))


def _single_or_mixed(values: Column) -> Column:
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, distinct[0]).otherwise("mixed")


def status_rollup(metrics: list[Column]) -> Column:
    """The common status, or ``mixed``; a missing metric counts as a status."""
    return _single_or_mixed(F.array(*[m["dataStatus"] for m in metrics]))


def confidence_rollup(metrics: list[Column]) -> Column:
    """Level and first-seen notes of the available metrics only."""
    seen = F.filter(
        F.array(*[F.when(m["dataStatus"] != fixed.MISSING, m["confidence"]) for m in metrics]),
        lambda c: c.isNotNull(),
    )
    level = F.when(F.size(seen) == 0, "unavailable").otherwise(
        _single_or_mixed(F.transform(seen, lambda c: c["level"]))
    )
    notes = F.array_distinct(F.transform(seen, lambda c: c["note"]))
    return F.struct(level.alias("level"), notes.alias("notes"))


def outputs_in_rollup_order(outputs: Column) -> list[Column]:
    return [outputs[name] for name in fixed.ROLLUP_ORDER]


def inputs_in_panel_order(inputs: Column) -> list[Column]:
    return [inputs[name] for name, _label, _unit, _kind in fixed.INPUT_PANEL]

"""Display rows: output and input panels, roll-ups and date cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline.functions import metrics as M
from liftline.functions import text as X
from liftline.functions.calendar import day_month_label


def _output_text(name: str, metric: Column, unit: str) -> Column:
    value = metric["value"]
    shown = X.capitalise(value) if name == "overdevelopmentRisk" else X.integer_label(value)
    return F.concat(shown, F.lit(unit))


def output_panel(records: DataFrame, keys: list[str], outputs: str = "outputs") -> DataFrame:
    """Five rows per record; a missing metric shows its reason and never a zero."""
    rows = []
    for pos, (name, label, unit) in enumerate(fixed.OUTPUT_PANEL):
        metric = F.col(f"{outputs}.{name}")
        gone = (metric["dataStatus"] == fixed.MISSING) | metric["value"].isNull()
        rows.append(
            F.struct(
                F.lit(pos).alias("pos"),
                F.lit(label).alias("label"),
                F.when(gone, fixed.UNAVAILABLE_TEXT)
                .otherwise(_output_text(name, metric, unit))
                .alias("value_text"),
                metric["dataStatus"].alias("data_status"),
                F.when(metric["dataStatus"] == fixed.MISSING, "unavailable")
                .otherwise(metric["confidence"]["level"])
                .alias("confidence_level"),
                F.when(metric["dataStatus"] == fixed.MISSING, metric["missingReason"])
                .otherwise(metric["confidence"]["note"])
                .alias("note"),
            )
        )
    return records.select(*keys, F.inline(F.array(*rows)))


_INPUT_TEXT = {
    "number": X.number_text,
    "integer": X.integer_label,
    "wind": X.wind_profile_text,
    "word": X.capitalise,
}


def input_panel(records: DataFrame, keys: list[str], inputs: str = "inputs") -> DataFrame:
    """Seventeen rows per record in panel order."""
    rows = []
    for pos, (name, label, unit, kind) in enumerate(fixed.INPUT_PANEL):
        metric = F.col(f"{inputs}.{name}")
        gone = metric["dataStatus"] == fixed.MISSING
        shown = F.concat(_INPUT_TEXT[kind](metric["value"]), F.lit(unit))
        rows.append(
            F.struct(
                F.lit(pos).alias("pos"),
                F.lit(name).alias("input"),
                F.lit(label).alias("label"),
                F.when(gone, fixed.UNAVAILABLE_TEXT).otherwise(shown).alias("value_text"),
                metric["dataStatus"].alias("data_status"),
                F.when(gone, metric["missingReason"]).alias("reason"),
            )
        )
    return records.select(*keys, F.inline(F.array(*rows)))


def output_status(outputs: Column) -> Column:
    return M.status_rollup(M.outputs_in_rollup_order(outputs))


def output_confidence(outputs: Column) -> Column:
    return M.confidence_rollup(M.outputs_in_rollup_order(outputs))


def input_status(inputs: Column) -> Column:
    return M.status_rollup(M.inputs_in_panel_order(inputs))


def date_cards(slots: DataFrame, selected: str) -> DataFrame:
    """Card texts and flags of preview slots (``today``, ``forecast_date``, metric)."""
    metric = F.col("chance100KmPct")
    today = F.col("forecast_date") == F.col("today")
    gone = metric["dataStatus"] == fixed.MISSING
    opening = F.when(today, "Today. ").otherwise("")
    sentence = F.when(
        gone, F.concat(opening, F.lit(fixed.CARD_UNAVAILABLE), metric["missingReason"])
    ).otherwise(
        F.concat(
            opening,
            X.number_text(metric["value"]),
            F.lit(fixed.CARD_CHANCE),
            metric["dataStatus"],
            F.lit(" data. "),
            metric["confidence"]["level"],
            F.lit(" confidence. "),
            metric["confidence"]["note"],
        )
    )
    return slots.withColumns(
        {
            "is_today": today,
            "is_selected": F.coalesce(F.col("forecast_date") == F.col(selected), F.lit(False)),
            "label": F.when(today, fixed.TODAY_TEXT).otherwise(
                day_month_label(F.col("forecast_date"))
            ),
            "value_text": F.when(gone, fixed.UNAVAILABLE_TEXT).otherwise(
                F.concat(X.integer_label(metric["value"]), F.lit("%"))
            ),
            "description": sentence,
        }
    )

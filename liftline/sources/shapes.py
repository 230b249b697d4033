"""Keys and JSON types of parsed JSON, tested by the type that Spark gives a variant.

The type text of an object lists its keys in order, so one pattern tests the keys and the
types of all objects inside it. The items of an array share one merged type there: a key
that only some items lack does not show, and has to be found by a rule on its value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftline import fixed_values as fixed
from liftline import schemas

NUMBER = r"(?:BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))"


def object_shape(**fields: str) -> str:
    """The pattern of an object with exactly these keys; Spark puts odd keys in quotes."""
    return "OBJECT<" + ", ".join(f"{name}: {fields[name]}" for name in sorted(fields)) + ">"


def either(*shapes: str) -> str:
    return "(?:" + "|".join(shapes) + ")"


def shape_of(kind: T.DataType) -> str:
    """The pattern of a declared type without nulls; an array may be empty."""
    if isinstance(kind, T.StructType):
        return object_shape(**{field.name: shape_of(field.dataType) for field in kind})
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{either(shape_of(kind.elementType), 'VOID')}>"
    if isinstance(kind, T.LongType):
        return "BIGINT"
    return NUMBER if isinstance(kind, T.DoubleType) else "STRING"


def metric_shape(value: str, with_confidence: bool = True) -> str:
    """A value and its status, or a reason in its place; a confidence beside them if asked for."""
    sure, unsure = ({"confidence": shape_of(schemas.CONFIDENCE)}, {"confidence": "VOID"}) if with_confidence else ({}, {})
    return either(
        object_shape(value=value, dataStatus="STRING", **sure),
        object_shape(value="VOID", dataStatus="STRING", missingReason="STRING", **unsure),
    )


def metrics_shape(schema: T.StructType, names: list[str], with_confidence: bool) -> dict[str, str]:
    return {name: metric_shape(shape_of(schema[name].dataType["value"].dataType), with_confidence) for name in names}


def document_shape() -> str:
    """The pattern of a detailed forecast document."""
    parts = {field.name: shape_of(field.dataType) for field in schemas.FORECAST_DOCUMENT}
    parts["outputs"] = object_shape(**metrics_shape(schemas.OUTPUTS, schemas.OUTPUTS.names, True))
    inputs = [name for name, _label, _unit, _kind in fixed.INPUT_PANEL]
    parts["forecastInputs"] = object_shape(
        provenance=shape_of(schemas.PROVENANCE), sourceRunAt="STRING", **metrics_shape(schemas.INPUTS, inputs, False)
    )
    return object_shape(**parts)


def has_shape(variant: Column, shape: str) -> Column:
    return F.coalesce(F.schema_of_variant(variant).rlike(f"^{shape}$"), F.lit(False))

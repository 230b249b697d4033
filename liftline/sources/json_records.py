"""Strict JSON documents in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftline import fixed_values as fixed
from liftline import schemas
from liftline.functions.issues import issue, issue_list, join_path, no_issues
from liftline.operators.rules import record_issues, unknown_field_issue
from liftline.sources.shapes import document_shape, has_shape

MALFORMED = "malformed-json"
SCHEMA = "schema-validation"


def _texts(schema: T.StructType) -> T.StructType:
    """The same fields, each left as its JSON text."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def _object_issues(json: Column, schema: T.StructType, path: str) -> list[Column]:
    """Unknown and absent keys of an object and of the objects inside it."""
    names = schema.names
    absent = F.array_except(
        F.array(*[F.lit(n) for n in names]),
        F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")),
    )
    found = [
        unknown_field_issue(json, names, path or "$"),
        F.when(
            F.size(absent) > 0,
            issue(join_path(path, absent[0]) if path else absent[0], fixed.REQUIRED),
        ),
    ]
    children = F.from_json(json, _texts(schema))
    for field in schema:
        if isinstance(field.dataType, T.StructType):
            inner = f"{path}.{field.name}" if path else field.name
            found += _object_issues(children[field.name], field.dataType, inner)
    return found


def _kinds(field: T.StructField) -> list[str]:
    """The JSON types, as a variant names them, that a field may have."""
    kind = field.dataType
    if isinstance(kind, T.StructType):
        found = ["OBJECT"]
    elif isinstance(kind, T.ArrayType):
        found = ["ARRAY"]
    elif isinstance(kind, T.BooleanType):
        found = ["BOOLEAN"]
    elif isinstance(kind, T.IntegralType):
        found = ["BIGINT"]
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        found = ["BIGINT", "DECIMAL", "DOUBLE"]
    else:
        found = ["STRING"]
    return [*found, "VOID"] if field.nullable else found


def _type_issues(variant: Column, schema: T.StructType, path: str, at: str = "$") -> list[Column]:
    """Fields with a value of another JSON type, or null where the schema does not allow it."""
    found = []
    for field in schema:
        here, name = f"{at}.{field.name}", f"{path}.{field.name}" if path else field.name
        kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get(variant, here, "variant")), r"^\w+", 0)
        # An absent field is reported as such.
        found.append(F.when(kind.isNotNull() & ~kind.isin(_kinds(field)), issue(name, fixed.WRONG_TYPE)))
        if isinstance(field.dataType, T.StructType):
            found += _type_issues(variant, field.dataType, name, here)
    return found


def parse_strict(rows: DataFrame, raw: str, schema: T.StructType) -> DataFrame:
    """``record`` of a flat or nested object whose keys are exactly those of ``schema``.

    ``failure_reason`` is null, ``malformed-json`` or ``schema-validation``. A value of
    another JSON type is a schema failure, at every level, and so is null unless the field
    of ``schema`` is nullable; items of arrays are read by ``schema`` alone. An object that
    repeats a key is malformed.
    """
    text = F.col(raw)
    corrupt = "_corrupt_record"
    with_corrupt = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = rows.withColumn("_parsed", F.from_json(text, with_corrupt))
    variant = F.try_parse_json(text)
    issues = issue_list(*_object_issues(text, schema, ""), *_type_issues(variant, schema, ""))
    reason = (
        F.when(F.try_parse_json(text).isNull(), MALFORMED)
        .when(F.json_object_keys(text).isNull(), SCHEMA)
        .when(F.col(f"_parsed.{corrupt}").isNotNull() | (F.size(issues) > 0), SCHEMA)
    )
    record = F.struct(*[F.col(f"_parsed.{name}").alias(name) for name in schema.names])
    return (
        parsed.withColumn("failure_reason", reason)
        .withColumn("record", F.when(F.col("failure_reason").isNull(), record))
        .drop("_parsed")
    )


_METRIC_KEYS = ["value", "dataStatus", "confidence"]
_INPUT_KEYS = ["value", "dataStatus"]


def parse_forecast_documents(rows: DataFrame, raw: str) -> DataFrame:
    """Raw text to typed document columns, ``issues`` and ``failure_reason``.

    Text that is no JSON is ``malformed-json``, without issues. Anything else that is not
    exactly a valid document is ``schema-validation``: one issue for its keys and JSON types,
    or, where these are as declared, all issues of its rules.
    """
    parsed = rows.withColumn("_v", F.try_parse_json(raw))
    document = F.try_variant_get("_v", "$", schemas.FORECAST_DOCUMENT.simpleString())
    found = (
        F.when(F.col("_v").isNull(), no_issues())
        .when(F.col("_doc").isNull(), issue("", fixed.WRONG_SHAPE))
        .otherwise(record_issues())
    )
    checked = (
        parsed.withColumn("_doc", F.when(has_shape(F.col("_v"), document_shape()), document))
        .select("*", "_doc.*")
        .withColumn("issues", found)
    )
    reason = F.when(F.col("_v").isNull(), MALFORMED).when(F.size("issues") > 0, SCHEMA)
    return checked.withColumn("failure_reason", reason).drop("_v", "_doc")


def split_documents(parsed: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """Good documents and quarantined raw text with its reason."""
    good = parsed.where("failure_reason IS NULL").drop("failure_reason", "issues")
    return good, parsed.where("failure_reason IS NOT NULL").select(raw, "failure_reason", "issues")


# --- Sink --------------------------------------------------------------------------


def _json(*columns: Column) -> Column:
    """JSON of a struct with its nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def metric_json(metric: Column, with_confidence: bool = True) -> Column:
    """Each branch has its own keys: no ``missingReason`` beside a value."""
    fields = _METRIC_KEYS if with_confidence else _INPUT_KEYS
    plain = [metric[name].alias(name) for name in fields]
    missing = _json(*plain, metric["missingReason"].alias("missingReason"))
    return F.when(metric["dataStatus"] == fixed.MISSING, missing).otherwise(_json(*plain))


def json_object(*pairs: tuple[str, Column]) -> Column:
    """An object around values that are JSON text already."""
    parts = []
    for i, (name, json) in enumerate(pairs):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), json]
    return F.concat(*parts, F.lit("}"))


def json_scalar(value: Column) -> Column:
    """JSON text of one scalar or nested value, with quotes and escapes."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return wrapped.substr(F.lit(6), F.length(wrapped) - 6)


def outputs_json(outputs: Column) -> Column:
    return json_object(
        *[(name, metric_json(outputs[name])) for name, _label, _unit in fixed.OUTPUT_PANEL]
    )


def inputs_json(inputs: Column) -> Column:
    return json_object(
        ("provenance", json_scalar(inputs["provenance"])),
        ("sourceRunAt", json_scalar(inputs["sourceRunAt"])),
        *[
            (name, metric_json(inputs[name], with_confidence=False))
            for name, _label, _unit, _kind in fixed.INPUT_PANEL
        ],
    )


def document_json(record: Column) -> Column:
    """JSON text of a detailed forecast record."""
    return json_object(
        ("siteId", json_scalar(record["siteId"])),
        ("siteSlug", json_scalar(record["siteSlug"])),
        ("forecastDate", json_scalar(record["forecastDate"])),
        ("generatedAt", json_scalar(record["generatedAt"])),
        ("provenance", json_scalar(record["provenance"])),
        ("outputs", outputs_json(record["outputs"])),
        ("forecastInputs", inputs_json(record["forecastInputs"])),
        ("topDrivers", json_scalar(record["topDrivers"])),
    )


def summary_json(summary: Column) -> Column:
    """JSON text of an available or missing summary, each with its own keys."""
    identity = [
        (name, json_scalar(summary[name]))
        for name in ("availability", "siteId", "siteSlug", "forecastDate")
    ]
    available = json_object(
        *identity,
        ("generatedAt", json_scalar(summary["generatedAt"])),
        ("provenance", json_scalar(summary["provenance"])),
        ("outputs", outputs_json(summary["outputs"])),
    )
    missing = json_object(*identity, ("missingReason", json_scalar(summary["missingReason"])))
    return F.when(summary["availability"] == fixed.MISSING, missing).otherwise(available)


def write_json_lines(documents: DataFrame, json: str, path: str) -> None:
    """One document per line."""
    documents.select(F.col(json).alias("value")).write.mode("overwrite").text(path)

"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from liftline import fixed_values as fixed


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()

PROVENANCE = _struct(source=_S, version=_S)
CONFIDENCE = _struct(level=_S, note=_S)
WIND_LEVEL = _struct(altitudeMslM=_D, directionDeg=_D, speedKmh=_D)

SITE = _struct(id=_L, slug=_S, name=_S, latitude=_D, longitude=_D)


def output_metric(value: T.DataType) -> T.StructType:
    return _struct(value=value, dataStatus=_S, confidence=CONFIDENCE, missingReason=_S)


def input_metric(value: T.DataType) -> T.StructType:
    return _struct(value=value, dataStatus=_S, missingReason=_S)


OUTPUTS = T.StructType(
    [
        T.StructField(name, output_metric(_S if name == "overdevelopmentRisk" else _D))
        for name, _label, _unit in fixed.OUTPUT_PANEL
    ]
)

_INPUT_VALUE = {"wind": T.ArrayType(WIND_LEVEL), "word": _S}
INPUTS = T.StructType(
    [T.StructField("provenance", PROVENANCE), T.StructField("sourceRunAt", _S)]
    + [
        T.StructField(name, input_metric(_INPUT_VALUE.get(kind, _D)))
        for name, _label, _unit, kind in fixed.INPUT_PANEL
    ]
)

# A detailed forecast document; dates and instants stay text until checked.
FORECAST_DOCUMENT = _struct(
    siteId=_L,
    siteSlug=_S,
    forecastDate=_S,
    generatedAt=_S,
    provenance=PROVENANCE,
    outputs=OUTPUTS,
    forecastInputs=INPUTS,
    topDrivers=T.ArrayType(_S),
)

# A summary, available or missing; each branch fills its own fields.
SUMMARY = _struct(
    availability=_S,
    siteId=_L,
    siteSlug=_S,
    forecastDate=_S,
    generatedAt=_S,
    provenance=PROVENANCE,
    outputs=OUTPUTS,
    missingReason=_S,
)

# Response bodies.
SITES_RESPONSE = _struct(sites=T.ArrayType(SITE))
SUMMARIES_RESPONSE = _struct(forecastDate=_S, summaries=T.ArrayType(SUMMARY))
DAYS_RESPONSE = _struct(
    siteId=_L,
    siteSlug=_S,
    timeZone=_S,
    todayDate=_S,
    days=T.ArrayType(_struct(forecastDate=_S, chance100KmPct=output_metric(_D))),
)

PROBLEM = _struct(
    type=_S,
    title=_S,
    status=_L,
    detail=_S,
    code=_S,
    requestId=_S,
    issues=T.ArrayType(_struct(path=_S, message=_S)),
)

# One record per (site_id, forecast_date); runs share the shape plus run_id.
PREDICTION = _struct(
    site_id=_L,
    forecast_date=T.DateType(),
    generated_at=T.TimestampType(),
    provenance=PROVENANCE,
    data_status=_S,
    confidence=CONFIDENCE,
    cloudbase_msl_m=_D,
    p100=_D,
    p200=_D,
    p300=_D,
    od_risk=_S,
    inputs=INPUTS,
    top_drivers=T.ArrayType(_S),
)

FLIGHT_RECORD = _struct(
    flight_id=_L,
    flight_date=T.DateType(),
    pilot=_S,
    source=_S,
    source_url=_S,
    launch_area=_S,
    start_latitude=_D,
    start_longitude=_D,
    landing_latitude=_D,
    landing_longitude=_D,
    distance_km=_D,
    duration_min=_L,
    track_url=_S,
    quality_note=_S,
    retrieved_at=T.TimestampType(),
)

WEATHER_FEATURES = _struct(
    site_id=_L,
    valid_date=T.DateType(),
    model_run_time=T.TimestampType(),
    temp_c=_D,
    dew_point_c=_D,
    boundary_layer_height_m=_D,
    thermal_strength_mps=_D,
    wind_by_altitude=T.ArrayType(WIND_LEVEL),
    humidity_pct=_D,
    cape_j_per_kg=_D,
    cin_j_per_kg=_D,
    precipitation_mm=_D,
    cloud_cover_pct=_D,
    source=_S,
)

SOUNDING_LEVEL = _struct(
    pressure_hpa=_D,
    height_m=_D,
    temp_c=_D,
    dew_point_c=_D,
    wind_direction_deg=_D,
    wind_speed_mps=_D,
)

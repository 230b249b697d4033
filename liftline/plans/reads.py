"""Sources, projections, lookups and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftline import schemas
from liftline.functions.calendar import local_date, shift_days
from liftline.operators import correlation, lookups, readmodels, scenarios
from liftline.operators import catalog as catalog_ops
from liftline.operators import panels, rules
from liftline.plans import views as V
from liftline.plans.oracle_views import SOFIA, day, integer_text, iso, number_text, with_views
from liftline.plans.registry import query
from liftline.session import scratch_path
from liftline.sources import json_records, tables
from liftline.sources.snapshots import Snapshots

GAVE_NONE = readmodels.NO_RUN_VALUE


def flat_metric(metric: Column, prefix: str) -> list[Column]:
    return [
        metric["value"].alias(f"{prefix}_value"),
        metric["dataStatus"].alias(f"{prefix}_status"),
        metric["confidence"]["level"].alias(f"{prefix}_level"),
        metric["confidence"]["note"].alias(f"{prefix}_note"),
        metric["missingReason"].alias(f"{prefix}_reason"),
    ]


def sql_metric(value: str, prefix: str, alias: str = "") -> str:
    """The flat metric of a run or prediction row, for the SQL twin."""
    t = f"{alias}." if alias else ""
    gone = f"{t}data_status = 'missing'"
    return f"""CASE WHEN NOT ({gone}) THEN {t}{value} END AS {prefix}_value, {t}data_status AS {prefix}_status,
  CASE WHEN NOT ({gone}) THEN {t}confidence_level END AS {prefix}_level,
  CASE WHEN NOT ({gone}) THEN {t}confidence_note END AS {prefix}_note,
  CASE WHEN {gone} THEN '{GAVE_NONE}' END AS {prefix}_reason"""


SHORT = {
    "cloudbaseMslM": ("cloudbase", "cloudbase_msl_m"),
    "chance100KmPct": ("c100", "p100"),
    "chance200KmPct": ("c200", "p200"),
    "chance300KmPct": ("c300", "p300"),
    "overdevelopmentRisk": ("risk", "od_risk"),
}


def flat_outputs(outputs: Column) -> list[Column]:
    return [c for name, (prefix, _v) in SHORT.items() for c in flat_metric(outputs[name], prefix)]


def sql_outputs(alias: str = "") -> str:
    return ",\n  ".join(sql_metric(value, prefix, alias) for prefix, value in SHORT.values())


# --- Sources ---------------------------------------------------------------------


@query("a01_site_catalog", with_views(("sites_x",), "SELECT id, slug, name, latitude, longitude FROM sites_x"))
def site_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.conform(V.sites(spark, sf_dir), schemas.SITE)


@query(
    "a02_prediction_table",
    with_views(
        ("preds",),
        f"""SELECT site_id, {day('forecast_date')} AS forecast_date, {iso('generated_at')} AS generated_at,
  source, version, data_status, confidence_level, confidence_note, cloudbase_msl_m, p100, p200, p300,
  od_risk, n_drivers FROM preds""",
    ),
)
def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.predictions(spark, sf_dir, inputs=True).drop("run_id", "k")
    return tables.conform(rows, schemas.PREDICTION).select(
        "site_id", "forecast_date", "generated_at", "provenance.source", "provenance.version",
        "data_status",
        F.col("confidence.level").alias("confidence_level"),
        F.col("confidence.note").alias("confidence_note"),
        "cloudbase_msl_m", "p100", "p200", "p300", "od_risk",
        F.size("top_drivers").alias("n_drivers"),
    )


_PAYLOAD = T.StructType(
    [
        T.StructField("k", T.LongType(), False),
        T.StructField("tag", T.StructType([T.StructField("type", T.StringType(), False)]), False),
    ]
)


def _raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event payloads with a nested tag; some cut short, some with other keys or types."""
    kind = F.col("event_id") % 12
    tag = F.concat(F.lit('"tag": {"type": "'), F.col("event_type"), F.lit('"'))
    body = F.regexp_replace("props", r"\}\s*\z", "")
    raw = (
        F.when(kind == 0, F.concat(body, F.lit(", "), tag, F.lit("}")))
        .when(kind == 1, F.concat(body, F.lit(", "), tag, F.lit("}, \"x\": 1}")))
        .when(kind == 2, F.concat(body, F.lit(", "), tag, F.lit(", \"y\": null}}")))
        .when(kind == 3, F.concat(F.lit('{"k": "'), F.col("k").cast("string"), F.lit('", '), tag, F.lit("}}")))
        .when(kind == 4, F.col("props"))
        .when(kind == 5, F.lit("[1, 2]"))
        .when(kind == 8, F.concat(body, F.lit(', "tag": {"type": 5}}')))
        .when(kind == 9, F.concat(body, F.lit(', "tag": {"type": null}}')))
        .when(kind == 10, F.concat(F.lit('{"k": null, '), tag, F.lit("}}")))
        .when(kind == 11, F.concat(F.lit('{"k": 1.5, '), tag, F.lit("}}")))
        .otherwise(F.concat(body, F.lit(", "), tag, F.lit("}}")))
    )
    return V.event_rows(spark, sf_dir).select("event_id", raw.alias("raw"))


_RUN = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("forecast_date", T.DateType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("data_status", T.StringType()),
        T.StructField("p100", T.DoubleType()),
        T.StructField("top_drivers", T.ArrayType(T.StringType())),
    ]
)


@query(
    "a02_keyed_insert",
    with_views(
        ("preds",),
        f"""SELECT site_id, {day('forecast_date')} AS forecast_date, {iso('generated_at')} AS generated_at, run_id, data_status, p100,
  n_drivers, 2 AS n_versions FROM preds""",
    ),
)
def keyed_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the runs inserted into a table of the others, then the others once more."""
    table = Snapshots(spark, scratch_path(spark, "runs"), _RUN, "forecast_date")
    runs = V.prediction_runs(spark, sf_dir).select(*_RUN.names)
    first = F.col("run_id") % 3 == 0
    newest = [F.col("generated_at").desc(), F.col("run_id").desc()]
    for batch in (runs.where(first), runs.where(~first), runs.where(first)):
        table.merge(batch, lookups.PREDICTION_KEY, newest)
    return table.read().select(
        "site_id", "forecast_date", "generated_at", "run_id", "data_status", "p100",
        F.size("top_drivers").alias("n_drivers"), F.lit(len(table.versions())).alias("n_versions"),
    )


@query(
    "a03_strict_json_source",
    with_views(
        ("ev",),
        """SELECT event_id, failure_reason,
  CASE WHEN failure_reason IS NULL THEN CAST(raw->>'$.k' AS BIGINT) END AS k,
  CASE WHEN failure_reason IS NULL THEN raw->>'$.tag.type' END AS tag_type FROM (
SELECT event_id, raw, CASE WHEN NOT json_valid(raw) THEN 'malformed-json'
  WHEN json_type(raw) <> 'OBJECT' OR list_sort(json_keys(raw)) <> ['k', 'tag']
    OR json_type(raw, '$.k') NOT IN ('UBIGINT', 'BIGINT') OR json_type(raw, '$.tag') <> 'OBJECT'
    OR json_keys(raw, '$.tag') <> ['type'] OR json_type(raw, '$.tag.type') <> 'VARCHAR'
  THEN 'schema-validation' END AS failure_reason FROM raws) t""",
        raws="""SELECT event_id, CASE event_id % 12
  WHEN 0 THEN '{"k": ' || k || ', "tag": {"type": "' || event_type || '"}'
  WHEN 1 THEN '{"k": ' || k || ', "tag": {"type": "' || event_type || '"}, "x": 1}'
  WHEN 2 THEN '{"k": ' || k || ', "tag": {"type": "' || event_type || '", "y": null}}'
  WHEN 3 THEN '{"k": "' || k || '", "tag": {"type": "' || event_type || '"}}'
  WHEN 4 THEN props WHEN 5 THEN '[1, 2]'
  WHEN 8 THEN '{"k": ' || k || ', "tag": {"type": 5}}' WHEN 9 THEN '{"k": ' || k || ', "tag": {"type": null}}'
  WHEN 10 THEN '{"k": null, "tag": {"type": "' || event_type || '"}}' WHEN 11 THEN '{"k": 1.5, "tag": {"type": "' || event_type || '"}}'
  ELSE '{"k": ' || k || ', "tag": {"type": "' || event_type || '"}}' END AS raw FROM ev""",
    ),
)
def strict_json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = json_records.parse_strict(_raw_payloads(spark, sf_dir), "raw", _PAYLOAD)
    return parsed.select(
        "event_id", "failure_reason", F.col("record.k").alias("k"),
        F.col("record.tag.type").alias("tag_type"),
    )


def sql_json_metric(value: str, text: bool = False) -> str:
    shown = f"'\"' || {value} || '\"'" if text else f"CAST({value} AS VARCHAR)"
    return f"""CASE WHEN data_status = 'missing'
    THEN '{{"value":null,"dataStatus":"missing","confidence":null,"missingReason":"{GAVE_NONE}"}}'
    ELSE '{{"value":' || {shown} || ',"dataStatus":"' || data_status || '","confidence":{{"level":"'
      || confidence_level || '","note":"' || confidence_note || '"}}}}' END"""


@query(
    "a04_json_sink",
    with_views(
        ("preds",),
        f"""SELECT run_id, '{{"cloudbaseMslM":' || {sql_json_metric('cloudbase_msl_m')}
  || ',"chance100KmPct":' || {sql_json_metric('p100')} || ',"chance200KmPct":' || {sql_json_metric('p200')}
  || ',"chance300KmPct":' || {sql_json_metric('p300')} || ',"overdevelopmentRisk":' || {sql_json_metric('od_risk', True)}
  || '}}' AS outputs_json FROM preds""",
    ),
)
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = V.predictions(spark, sf_dir).select("run_id", readmodels.outputs().alias("outputs"))
    return outputs.select("run_id", json_records.outputs_json(F.col("outputs")).alias("outputs_json"))


# --- Projections -----------------------------------------------------------------


@query("a05_metric_wrap", with_views(("runs",), f"SELECT run_id, {sql_metric('p100', 'c100')} FROM runs"))
def metric_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.prediction_runs(spark, sf_dir)
    wrapped = rows.select("run_id", readmodels.metric_of("p100").alias("m"))
    return wrapped.select("run_id", *flat_metric(F.col("m"), "c100"))


@query("a06_outputs_projection", with_views(("preds",), f"SELECT run_id, {sql_outputs()} FROM preds"))
def outputs_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.predictions(spark, sf_dir).select("run_id", readmodels.outputs().alias("o"))
    return rows.select("run_id", *flat_outputs(F.col("o")))


@query(
    "a07_detailed_record",
    with_views(
        ("preds", "sites_x"),
        f"""SELECT site_id, slug, {day('forecast_date')} AS forecast_date, {iso('generated_at')} AS generated_at,
  source, version, {sql_outputs()}, {iso('generated_at')} AS source_run_at,
  CASE WHEN data_status <> 'missing' AND k % 7 <> 0 THEN k * 12.5::DOUBLE END AS cape,
  CASE WHEN data_status <> 'missing' THEN k * 0.25::DOUBLE + 23 END AS upper_wind,
  CASE n_drivers WHEN 1 THEN 'Thermal strength' WHEN 2 THEN 'Thermal strength|Cloudbase estimate'
    ELSE 'Thermal strength|Cloudbase estimate|Wind alignment' END AS drivers
FROM preds JOIN sites_x ON preds.site_id = sites_x.id""",
    ),
)
def detailed_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.sites(spark, sf_dir).select(F.col("id").alias("site_id"), "slug")
    predictions = V.predictions(spark, sf_dir, inputs=True)
    records = predictions.join(known, "site_id").select(*readmodels.detailed_record())
    return records.select(
        F.col("siteId").alias("site_id"), F.col("siteSlug").alias("slug"),
        F.col("forecastDate").alias("forecast_date"), F.col("generatedAt").alias("generated_at"),
        "provenance.source", "provenance.version",
        *flat_outputs(F.col("outputs")),
        F.col("forecastInputs.sourceRunAt").alias("source_run_at"),
        F.col("forecastInputs.capeJPerKg.value").alias("cape"),
        F.col("forecastInputs.windByAltitude.value")[1]["speedKmh"].alias("upper_wind"),
        F.array_join("topDrivers", "|").alias("drivers"),
    )


@query(
    "a08_available_summary",
    with_views(
        ("preds", "sites_x"),
        f"""SELECT 'available' AS availability, site_id, slug, {day('forecast_date')} AS forecast_date,
  {iso('generated_at')} AS generated_at, version, {sql_outputs()}
FROM preds JOIN sites_x ON preds.site_id = sites_x.id""",
    ),
)
def available_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.sites(spark, sf_dir).select(F.col("id").alias("site_id"), "slug")
    rows = V.predictions(spark, sf_dir).join(known, "site_id")
    summaries = rows.select(readmodels.available_summary().alias("s"))
    return summaries.select(
        "s.availability", F.col("s.siteId").alias("site_id"), F.col("s.siteSlug").alias("slug"),
        F.col("s.forecastDate").alias("forecast_date"), F.col("s.generatedAt").alias("generated_at"),
        "s.provenance.version", *flat_outputs(F.col("s.outputs")),
    )


# --- Requests --------------------------------------------------------------------


def checked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid summary requests only: parsed slugs and date."""
    raw = V.requests(spark, sf_dir).withColumn("date_text", F.col("request_date").cast("string"))
    return rules.valid_summary_requests(raw).select("request_id", "forecast_date", "slugs")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.batched_summaries(
        checked_requests(spark, sf_dir), V.sites(spark, sf_dir), V.predictions(spark, sf_dir)
    )


# Items of valid requests: both slugs differ; site_id is null for an unknown slug.
SQL_ITEMS = """SELECT r.request_id, r.request_date AS forecast_date, i.pos AS slug_pos, i.slug, s.id AS site_id
  FROM reqs r CROSS JOIN LATERAL (SELECT 0 AS pos, r.slug AS slug UNION ALL SELECT 1, r.slug2) i
  LEFT JOIN sites_x s ON s.slug = i.slug WHERE r.slug <> r.slug2"""
SQL_RESOLVED = """SELECT *, sum(CASE WHEN site_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS bad,
  row_number() OVER (PARTITION BY request_id ORDER BY site_id) - 1 AS pos FROM items"""
SQL_SUMMARIES = """SELECT w.request_id, w.pos, w.site_id AS wanted_id, w.slug, w.forecast_date AS wanted_date, p.*
  FROM resolved w LEFT JOIN preds p ON p.site_id = w.site_id AND p.forecast_date = w.forecast_date
  WHERE w.bad = 0"""
SUMMARY_VIEWS = ("preds", "sites_x", "reqs")
SUMMARY_CHAIN = {"items": SQL_ITEMS, "resolved": SQL_RESOLVED, "sums": SQL_SUMMARIES}


@query(
    "a09_missing_summary",
    with_views(
        SUMMARY_VIEWS,
        f"""SELECT request_id, 'missing' AS availability, wanted_id AS site_id, slug,
  {day('wanted_date')} AS forecast_date,
  'No forecast exists for site ''' || slug || ''' on ' || {day('wanted_date')} || '.' AS missing_reason
FROM sums WHERE run_id IS NULL""",
        **SUMMARY_CHAIN,
    ),
)
def missing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = readmodels.missing_sites(
        checked_requests(spark, sf_dir), V.sites(spark, sf_dir), V.predictions(spark, sf_dir)
    )
    return missing.select(
        "request_id", "summary.availability", F.col("summary.siteId").alias("site_id"),
        F.col("summary.siteSlug").alias("slug"), F.col("summary.forecastDate").alias("forecast_date"),
        F.col("summary.missingReason").alias("missing_reason"),
    )


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.requests(spark, sf_dir).select(
        "request_id", "slug", local_date(F.col("requested_at")).alias("today")
    )
    return readmodels.day_preview(asked, V.sites(spark, sf_dir), V.predictions(spark, sf_dir))


SQL_SLOTS = f"""SELECT q.request_id, q.today, q.site_id, q.slug, q.pos, q.slot_date, p.run_id IS NOT NULL AS found,
  p.* EXCLUDE (site_id) FROM (
  SELECT r.request_id, r.today, s.id AS site_id, r.slug, d.pos, r.today + CAST(d.pos - 2 AS INT) AS slot_date
  FROM (SELECT request_id, slug, CAST({SOFIA.replace('ts', 'requested_at')} AS DATE) AS today FROM reqs) r
  JOIN sites_x s ON s.slug = r.slug
  CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS pos) d) q
  LEFT JOIN preds p ON p.site_id = q.site_id AND p.forecast_date = q.slot_date"""
SQL_NO_DAY = f"""'No 100+ km forecast is available for site ''' || slug || ''' on ' || {day('slot_date')} || '.'"""
SQL_DAY = """CASE WHEN found AND data_status <> 'missing' THEN p100 END AS c100_value,
  CASE WHEN found THEN data_status ELSE 'missing' END AS c100_status,
  CASE WHEN found AND data_status <> 'missing' THEN confidence_level END AS c100_level,
  CASE WHEN found AND data_status <> 'missing' THEN confidence_note END AS c100_note,
  CASE WHEN NOT found THEN {no_day}
    WHEN data_status = 'missing' THEN '{gave_none}' END AS c100_reason""".replace("{no_day}", SQL_NO_DAY).replace("{gave_none}", GAVE_NONE)


@query(
    "a10_day_metric",
    with_views(
        SUMMARY_VIEWS,
        f"SELECT request_id, pos, {day('slot_date')} AS forecast_date, {SQL_DAY} FROM slots",
        slots=SQL_SLOTS,
    ),
)
def day_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(spark, sf_dir).select(
        "request_id", "pos", "forecast_date", *flat_metric(F.col("chance100KmPct"), "c100")
    )


# --- Panels ----------------------------------------------------------------------


def mixed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose five metrics differ in status: some 300+ km missing, some cloudbases manual."""
    k = F.col("k")
    rows = V.prediction_runs(spark, sf_dir).withColumn("o", readmodels.outputs())
    gone = readmodels.M.missing_metric("double", F.lit("No 300+ km estimate."))
    manual = F.struct(
        F.col("o.cloudbaseMslM.value").alias("value"),
        F.lit("manual").alias("dataStatus"),
        readmodels.M.confidence(F.lit("high"), F.lit("Checked by hand.")).alias("confidence"),
        F.lit(None).cast("string").alias("missingReason"),
    )
    available = F.col("data_status") != "missing"
    changed = F.struct(
        F.when((k % 4 == 0) & available, manual).otherwise(F.col("o.cloudbaseMslM")).alias("cloudbaseMslM"),
        F.col("o.chance100KmPct"),
        F.col("o.chance200KmPct"),
        F.when(k % 7 == 0, gone).otherwise(F.col("o.chance300KmPct")).alias("chance300KmPct"),
        F.col("o.overdevelopmentRisk"),
    )
    return rows.select("run_id", "k", changed.alias("outputs"))


# Statuses, levels, notes and reasons of the five mixed metrics, one column each.
SQL_MIXED = f"""SELECT *, data_status AS st100, data_status AS st200,
  CASE WHEN k % 4 = 0 AND data_status <> 'missing' THEN 'manual' ELSE data_status END AS stcb,
  CASE WHEN k % 7 = 0 THEN 'missing' ELSE data_status END AS st300, data_status AS strisk,
  CASE WHEN k % 4 = 0 AND data_status <> 'missing' THEN 'high' ELSE confidence_level END AS lvcb,
  CASE WHEN k % 4 = 0 AND data_status <> 'missing' THEN 'Checked by hand.' ELSE confidence_note END AS ntcb,
  CASE WHEN k % 7 = 0 THEN 'No 300+ km estimate.' ELSE '{GAVE_NONE}' END AS re300 FROM runs"""


def _sql_panel_row(pos: int, label: str, status: str, text: str, level: str, note: str, reason: str) -> str:
    return f"""{{'pos': {pos}, 'label': '{label}', 'value_text': CASE WHEN {status} = 'missing' THEN 'Unavailable' ELSE {text} END,
    'data_status': {status}, 'confidence_level': CASE WHEN {status} = 'missing' THEN 'unavailable' ELSE {level} END,
    'note': CASE WHEN {status} = 'missing' THEN {reason} ELSE {note} END}}"""


_PLAIN = ("confidence_level", "confidence_note", f"'{GAVE_NONE}'")


@query(
    "a11_output_panel",
    with_views(
        ("runs",),
        "SELECT run_id, u.* FROM (SELECT run_id, unnest(["
        + ",\n  ".join(
            [
                _sql_panel_row(0, "Cloudbase", "stcb", integer_text("cloudbase_msl_m") + " || ' m MSL'", "lvcb", "ntcb", f"'{GAVE_NONE}'"),
                _sql_panel_row(1, "100+ km chance", "st100", integer_text("p100") + " || '%'", *_PLAIN),
                _sql_panel_row(2, "200+ km chance", "st200", integer_text("p200") + " || '%'", *_PLAIN),
                _sql_panel_row(3, "300+ km chance", "st300", integer_text("p300") + " || '%'", "confidence_level", "confidence_note", "re300"),
                _sql_panel_row(4, "Overdevelopment", "strisk", "upper(substr(od_risk, 1, 1)) || substr(od_risk, 2)", *_PLAIN),
            ]
        )
        + "]) AS u FROM mixed) t",
        mixed=SQL_MIXED,
    ),
)
def output_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.output_panel(mixed_outputs(spark, sf_dir), ["run_id"])


def _sql_linear(factor: str, base: str) -> str:
    return number_text(f"(k::DOUBLE * {factor}::DOUBLE + {base}::DOUBLE)")


_SQL_INPUTS = [
    ("surfaceTemperatureC", "Surface temperature", _sql_linear("0.25", "10") + " || ' °C'"),
    ("dewPointC", "Dew point", _sql_linear("0.125", "2") + " || ' °C'"),
    ("boundaryLayerHeightM", "Boundary-layer height", integer_text("k * 15 + 800") + " || ' m'"),
    ("thermalStrengthMps", "Thermal strength", _sql_linear("0.03125", "0.5") + " || ' m/s'"),
    ("boundaryLayerWindSpeedKmh", "Boundary-layer wind", _sql_linear("0.5", "4") + " || ' km/h'"),
    ("boundaryLayerWindDirectionDeg", "BL wind direction", _sql_linear("2", "100") + " || '°'"),
    ("windByAltitude", "Wind by altitude",
     f"'1,500 m: ' || {_sql_linear('0.25', '16')} || ' km/h · 2,500 m: ' || {_sql_linear('0.25', '23')} || ' km/h'"),
    ("windShearMpsPerKm", "Wind shear", _sql_linear("0.0625", "1") + " || ' m/s/km'"),
    ("relativeHumidityPct", "Relative humidity", _sql_linear("0.5", "30") + " || '%'"),
    ("capeJPerKg", "CAPE", _sql_linear("12.5", "0") + " || ' J/kg'"),
    ("cinJPerKg", "CIN", _sql_linear("0.5", "10") + " || ' J/kg'"),
    ("lapseRateCPerKm", "Lapse rate", _sql_linear("0.03125", "5") + " || ' °C/km'"),
    ("lowCloudCoverPct", "Low cloud", _sql_linear("0.5", "10") + " || '%'"),
    ("totalCloudCoverPct", "Total cloud", _sql_linear("0.5", "20") + " || '%'"),
    ("precipitationMm", "Precipitation", _sql_linear("0.0625", "0") + " || ' mm'"),
    ("surfacePressureHpa", "Surface pressure", _sql_linear("-0.25", "1020") + " || ' hPa'"),
    ("convergenceSignal", "Convergence", "CASE k % 4 WHEN 0 THEN 'Absent' WHEN 1 THEN 'Weak' WHEN 2 THEN 'Moderate' ELSE 'Strong' END"),
]


def _sql_input_row(pos: int, name: str, label: str, text: str) -> str:
    status = "CASE WHEN k % 7 = 0 THEN 'missing' ELSE data_status END" if name == "capeJPerKg" else "data_status"
    return f"""{{'pos': {pos}, 'input': '{name}', 'label': '{label}',
    'value_text': CASE WHEN {status} = 'missing' THEN 'Unavailable' ELSE {text} END, 'data_status': {status},
    'reason': CASE WHEN {status} = 'missing' THEN 'No input for k ' || k END}}"""


@query(
    "a12_input_panel",
    with_views(
        ("preds",),
        "SELECT run_id, u.* FROM (SELECT run_id, unnest(["
        + ",\n  ".join(_sql_input_row(i, *row) for i, row in enumerate(_SQL_INPUTS))
        + "]) AS u FROM preds) t",
    ),
)
def input_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.input_panel(V.predictions(spark, sf_dir, inputs=True), ["run_id"])


# --- Lookups ---------------------------------------------------------------------


@query("a13_list_sites", with_views(("sites_x",), "SELECT id, slug, name FROM sites_x ORDER BY id"))
def list_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.list_sites(V.sites(spark, sf_dir).select("id", "slug", "name"))


@query(
    "a14_site_by_slug",
    with_views(
        ("reqs", "sites_x"),
        "SELECT r.request_id, s.id AS site_id, s.name, s.latitude, s.longitude FROM reqs r JOIN sites_x s ON s.slug = r.slug",
    ),
)
def site_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.requests(spark, sf_dir).select("request_id", "slug")
    return lookups.sites_by_slug(asked, V.sites(spark, sf_dir)).select(
        "request_id", F.col("id").alias("site_id"), "name", "latitude", "longitude"
    )


@query(
    "a15_point_lookup",
    with_views(
        ("reqs", "preds"),
        f"""SELECT r.request_id, p.site_id, {day('p.forecast_date')} AS forecast_date, p.run_id, p.p100
FROM reqs r JOIN preds p ON p.site_id = r.user_id + 1 AND p.forecast_date = r.request_date""",
    ),
)
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.requests(spark, sf_dir).select(
        "request_id", (F.col("user_id") + 1).alias("site_id"), F.col("request_date").alias("forecast_date")
    )
    found = lookups.point_lookup(asked, V.predictions(spark, sf_dir))
    return found.select("request_id", "site_id", "forecast_date", "run_id", "p100")


@query(
    "a15_lookup_in_place",
    with_views(
        ("reqs", "preds"),
        f"""SELECT r.request_id, p.site_id, {day('p.forecast_date')} AS forecast_date, p.run_id, p.p100
FROM reqs r JOIN preds p ON p.site_id = CASE WHEN r.k % 3 = 0 THEN 1 ELSE r.user_id + 1 END AND p.forecast_date = r.request_date""",
    ),
)
def lookup_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the requests ask for one site; the prediction table is written in buckets and not shuffled."""
    site = F.when(F.col("k") % 3 == 0, F.lit(1)).otherwise(F.col("user_id") + 1).cast("long")
    asked = V.requests(spark, sf_dir).select("request_id", site.alias("site_id"), F.col("request_date").alias("forecast_date"))
    path = scratch_path(spark, "bucketed")
    written = V.predictions(spark, sf_dir).select("site_id", "forecast_date", "run_id", "p100")
    table = tables.save_bucketed(written, f"predictions_{path[-32:]}", path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = lookups.point_lookup_in_place(asked, table)
    return found.select("request_id", "site_id", "forecast_date", "run_id", "p100")


@query(
    "a16_multi_site_read",
    with_views(
        ("reqs", "preds"),
        f"""SELECT q.request_id, q.pos, q.site_id, {day('q.request_date')} AS forecast_date, p.p100, p.data_status
FROM (SELECT request_id, request_date, unnest([0, 1, 2]) AS pos,
    unnest([user_id + 1, k % 10 + 1, user_id + 1]) AS site_id FROM reqs) q
JOIN preds p ON p.site_id = q.site_id AND p.forecast_date = q.request_date""",
    ),
)
def multi_site_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = F.col("user_id") + 1, (F.col("k") % 10 + 1).cast("bigint")
    asked = V.requests(spark, sf_dir).select(
        "request_id", F.col("request_date").alias("forecast_date"),
        F.array(first, second, first).alias("site_ids"),
    )
    found = lookups.read_site_lists(asked, V.predictions(spark, sf_dir), "request_id")
    return found.select("request_id", "pos", "site_id", "forecast_date", "p100", "data_status")


@query(
    "a17_date_range_scan",
    with_views(
        ("reqs", "preds"),
        f"""SELECT r.request_id, p.site_id, {day('p.forecast_date')} AS forecast_date, p.p100
FROM reqs r JOIN preds p ON p.site_id = r.user_id + 1
  AND p.forecast_date BETWEEN r.request_date - 2 AND r.request_date + CAST(r.k % 4 AS INT)""",
    ),
)
def date_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.requests(spark, sf_dir).select(
        "request_id", (F.col("user_id") + 1).alias("site_id"),
        shift_days(F.col("request_date"), -2).alias("from_date"),
        shift_days(F.col("request_date"), F.col("k") % 4).alias("through_date"),
    )
    found = lookups.read_date_ranges(asked, V.predictions(spark, sf_dir))
    return found.select("request_id", "site_id", "forecast_date", "p100")


# --- Joins -----------------------------------------------------------------------


@query(
    "a18_batched_summaries",
    with_views(
        SUMMARY_VIEWS,
        f"""SELECT request_id, CAST(pos AS INT) AS pos, wanted_id AS site_id, slug, {day('wanted_date')} AS forecast_date,
  CASE WHEN run_id IS NULL THEN 'missing' ELSE 'available' END AS availability,
  CASE WHEN run_id IS NOT NULL THEN {iso('generated_at')} END AS generated_at, version, {sql_outputs()},
  CASE WHEN run_id IS NULL THEN 'No forecast exists for site ''' || slug || ''' on ' || {day('wanted_date')} || '.'
    END AS missing_reason
FROM sums""",
        **SUMMARY_CHAIN,
    ),
)
def batched_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir).select(
        "request_id", "pos", "site_id", "slug", "forecast_date", "summary.availability",
        F.col("summary.generatedAt").alias("generated_at"),
        F.col("summary.provenance.version").alias("version"),
        *flat_outputs(F.col("summary.outputs")),
        F.col("summary.missingReason").alias("missing_reason"),
    )


@query(
    "a19_five_day_preview",
    with_views(
        SUMMARY_VIEWS,
        f"""SELECT request_id, site_id, slug, {day('today')} AS today, pos, {day('slot_date')} AS forecast_date,
  {SQL_DAY} FROM slots""",
        slots=SQL_SLOTS,
    ),
)
def five_day_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(spark, sf_dir).select(
        "request_id", "site_id", "slug", "today", "pos", "forecast_date",
        *flat_metric(F.col("chance100KmPct"), "c100"),
    )


@query(
    "a20_detailed_lookup",
    with_views(
        SUMMARY_VIEWS,
        f"""SELECT r.request_id, r.slug, {day('r.request_date')} AS forecast_date,
  CASE WHEN s.id IS NULL THEN 'SITE_NOT_FOUND' WHEN p.run_id IS NULL THEN 'FORECAST_NOT_FOUND' ELSE 'found' END AS outcome,
  CASE WHEN s.id IS NULL THEN 'No forecast site exists for slug ''' || r.slug || '''.'
    WHEN p.run_id IS NULL THEN 'No forecast exists for site ''' || r.slug || ''' on ' || {day('r.request_date')} || '.' END AS detail,
  p.p100 AS c100, {iso('p.generated_at')} AS generated_at, p.n_drivers
FROM reqs r LEFT JOIN sites_x s ON s.slug = r.slug
LEFT JOIN preds p ON p.site_id = s.id AND p.forecast_date = r.request_date""",
    ),
)
def detailed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.requests(spark, sf_dir).select("request_id", "slug", F.col("request_date").alias("forecast_date"))
    found = readmodels.detailed_lookup(asked, V.sites(spark, sf_dir), V.predictions(spark, sf_dir, inputs=True))
    return found.select(
        "request_id", "slug", "forecast_date", "outcome", "detail",
        F.col("record.outputs.chance100KmPct.value").alias("c100"),
        F.col("record.generatedAt").alias("generated_at"),
        F.size("record.topDrivers").alias("n_drivers"),
    )


@query(
    "a21_unknown_slug_requests",
    with_views(
        ("reqs", "sites_x"),
        """SELECT request_id, arg_min(slug, slug_pos) AS slug, count(*) AS unknown_slugs,
  'No forecast site exists for slug ''' || arg_min(slug, slug_pos) || '''.' AS detail
FROM items WHERE site_id IS NULL GROUP BY request_id""",
        items=SQL_ITEMS,
    ),
)
def unknown_slug_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = readmodels.resolve_sites(checked_requests(spark, sf_dir), V.sites(spark, sf_dir))
    return readmodels.unknown_requests(resolved)


@query(
    "a22_latest_per_key",
    with_views(
        ("preds",),
        f"SELECT site_id, {day('forecast_date')} AS forecast_date, run_id, {iso('generated_at')} AS generated_at, p100 FROM preds",
    ),
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.predictions(spark, sf_dir).select("site_id", "forecast_date", "run_id", "generated_at", "p100")


@query(
    "a23_three_state_cards",
    with_views(
        SUMMARY_VIEWS,
        """SELECT c.request_id, c.slug, CASE WHEN s.slug IS NULL THEN 'omitted' WHEN s.run_id IS NULL THEN 'missing'
    ELSE 'available' END AS state, s.p100 AS c100
FROM (SELECT DISTINCT request_id, slug FROM (
    SELECT request_id, slug FROM resolved WHERE bad = 0
    UNION ALL SELECT r.request_id, o.slug FROM (SELECT DISTINCT request_id FROM resolved WHERE bad = 0) r
      CROSS JOIN (SELECT slug FROM sites_x ORDER BY id, slug LIMIT 3 OFFSET 1) o) u) c
LEFT JOIN sums s ON s.request_id = c.request_id AND s.slug = c.slug""",
        **SUMMARY_CHAIN,
    ),
)
def three_state_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards: the requested sites and the comparison sites, which a response may leave out."""
    site_rows = V.sites(spark, sf_dir)
    resolved = readmodels.resolve_sites(checked_requests(spark, sf_dir), site_rows).where("unknown_slugs = 0")
    response = readmodels.summaries_of(readmodels.with_predictions(resolved, V.predictions(spark, sf_dir)))
    answered = resolved.where("slug_pos = 0").select("request_id", "slugs")
    cards = answered.withColumn("others", catalog_ops.comparison_slugs(site_rows)).select(
        "request_id", F.explode(F.array_union("slugs", "others")).alias("slug")
    )
    joined = readmodels.three_state_cards(cards, response)
    return joined.select(
        "request_id", "slug", "state",
        F.col("summary.outputs.chance100KmPct.value").alias("c100"),
    )


@query(
    "a24_scenarios",
    with_views(
        ("preds",),
        f"""SELECT site_id, {day('forecast_date')} AS forecast_date, a.day_offset, {day('forecast_date + a.day_offset')} AS scenario_date,
  cloudbase_msl_m + a.d_cloudbase AS cloudbase_msl_m,
  CASE WHEN p100 IS NOT NULL THEN greatest(0::DOUBLE, least(100::DOUBLE, p100 + a.d100)) END AS p100,
  CASE WHEN p200 IS NOT NULL THEN greatest(0::DOUBLE, least(100::DOUBLE, p200 + a.d200)) END AS p200,
  CASE WHEN p300 IS NOT NULL THEN greatest(0::DOUBLE, least(100::DOUBLE, p300 + a.d300)) END AS p300, od_risk
FROM preds CROSS JOIN (VALUES (-2, -150, -10, -5, -2), (-1, -75, -5, -2, -1), (0, 0, 0, 0, 0),
  (1, 100, 8, 4, 1), (2, 50, -3, -1, 0)) AS a(day_offset, d_cloudbase, d100, d200, d300)""",
    ),
)
def scenario_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = V.predictions(spark, sf_dir).select(
        "site_id", "forecast_date", "cloudbase_msl_m", "p100", "p200", "p300", "od_risk"
    )
    return scenarios.expand_scenarios(profiles)


@query(
    "a25_response_correlation",
    with_views(
        ("reqs",),
        """SELECT request_id, 'forecast-days' AS resource, 'The forecast service returned days for a different location.' AS message
  FROM reqs WHERE k % 5 = 1 AND slug <> slug2
UNION ALL SELECT request_id, 'forecast-summaries', CASE WHEN k % 7 = 1
    THEN 'The forecast service returned summaries for a different date.'
    ELSE 'The forecast service returned a summary for an unrequested location.' END
  FROM reqs WHERE k % 7 = 1 OR k % 7 = 2
UNION ALL SELECT request_id, 'forecast-detail',
    'The forecast service returned a detailed forecast for a different location or date.'
  FROM reqs WHERE k % 6 = 1 OR (k % 6 = 2 AND slug <> slug2)""",
    ),
)
def response_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against responses of which some carry another site or date."""
    k = F.col("k")
    base = V.requests(spark, sf_dir).withColumn("slugs", rules.parse_slug_list(F.col("site_slugs")))
    asked = base.select("request_id", "slug", "slugs", F.col("request_date").alias("date"))
    second = F.col("slugs")[1]
    later = shift_days(F.col("request_date"), 1)
    days = base.select("request_id", F.when(k % 5 == 1, second).otherwise(F.col("slug")).alias("slug"))
    batch = base.select(
        "request_id",
        F.when(k % 7 == 1, later).otherwise(F.col("request_date")).alias("date"),
        F.when(k % 7 == 2, F.array(F.col("slug"), F.lit("elsewhere"))).otherwise(F.slice("slugs", 1, 1)).alias("slugs"),
    )
    detail = base.select(
        "request_id",
        F.when(k % 6 == 2, second).otherwise(F.col("slug")).alias("slug"),
        F.when(k % 6 == 1, later).otherwise(F.col("request_date")).alias("date"),
    )
    return (
        correlation.days_violations(asked, days)
        .unionByName(correlation.summaries_violations(asked, batch))
        .unionByName(correlation.detail_violations(asked, detail))
    )

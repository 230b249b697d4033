"""Whole JSON documents and response bodies, written and strictly read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline import schemas
from liftline.functions.calendar import iso_date
from liftline.operators import readmodels
from liftline.plans import checks as C
from liftline.plans import reads as R
from liftline.plans import views as V
from liftline.plans.oracle_views import day, iso, with_views
from liftline.plans.registry import query
from liftline.sources import json_records, responses

# --- SQL of the texts ------------------------------------------------------------


def _sql_object(**fields: str) -> str:
    """An object around SQL that gives JSON text."""
    return "'{' || " + " || ',' || ".join(f"""'"{name}":' || {text}""" for name, text in fields.items()) + " || '}'"


def _sql_text(value: str) -> str:
    return f"""'"' || {value} || '"'"""


_SQL_PROVENANCE = _sql_object(source=_sql_text("source"), version=_sql_text("version"))
_SQL_OUTPUTS = _sql_object(
    **{name: R.sql_json_metric(value, value == "od_risk") for name, (_prefix, value) in R.SHORT.items()}
)
_SQL_SUMMARY = _sql_object(
    availability="CASE WHEN run_id IS NULL THEN '\"missing\"' ELSE '\"available\"' END",
    siteId="wanted_id",
    siteSlug=_sql_text("slug"),
    forecastDate=_sql_text(day("wanted_date")),
)[: -len(" || '}'")]
_SQL_GIVEN = _sql_object(generatedAt=_sql_text(iso("generated_at")), provenance=_SQL_PROVENANCE, outputs=_SQL_OUTPUTS)
_SQL_GONE = _sql_object(
    missingReason=_sql_text(f"'No forecast exists for site ''' || slug || ''' on ' || {day('wanted_date')} || '.'")
)
_SQL_SUMMARIES_BODY = f"""SELECT request_id, '{{"forecastDate":"' || {day('any_value(wanted_date)')} || '","summaries":['
  || string_agg({_SQL_SUMMARY} || ',' || substr(CASE WHEN run_id IS NULL THEN {_SQL_GONE} ELSE {_SQL_GIVEN} END, 2), ',' ORDER BY pos)
  || ']}}' AS body, bool_or(run_id IS NULL) AS any_gone, bool_or(run_id IS NOT NULL) AS any_given, count(*) AS n
FROM sums GROUP BY request_id"""

_SQL_DAY_BODY = f"""SELECT request_id, any_value(site_id) AS site_id, any_value(slug) AS slug, any_value(today) AS today,
  count_if(data_status <> 'missing') AS n_given, {_sql_object(
    siteId="any_value(site_id)", siteSlug=_sql_text("any_value(slug)"), timeZone=f"'\"{fixed.FORECAST_ZONE}\"'",
    todayDate=_sql_text(day("any_value(today)")),
    days="'[' || string_agg(" + _sql_object(
        forecastDate=_sql_text(day("slot_date")),
        chance100KmPct="CASE WHEN found THEN " + R.sql_json_metric("p100") + " ELSE "
        + _sql_object(value="'null'", dataStatus="'\"missing\"'", confidence="'null'", missingReason=_sql_text(R.SQL_NO_DAY))
        + " END",
    ) + ", ',' ORDER BY pos) || ']'",
)} AS body FROM slots GROUP BY request_id"""


# --- Sinks -----------------------------------------------------------------------


@query(
    "a04_summaries_response",
    with_views(R.SUMMARY_VIEWS, "SELECT request_id, body FROM bodies", **R.SUMMARY_CHAIN, bodies=_SQL_SUMMARIES_BODY),
)
def summaries_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.summaries_responses(R.summaries(spark, sf_dir))


@query(
    "a04_days_response",
    with_views(R.SUMMARY_VIEWS, "SELECT request_id, body FROM bodies", slots=R.SQL_SLOTS, bodies=_SQL_DAY_BODY),
)
def days_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.days_responses(R.preview(spark, sf_dir))


# Inputs of ``views.py`` as values of k.
_SQL_LINEAR = {
    "surfaceTemperatureC": (0.25, 10), "dewPointC": (0.125, 2), "boundaryLayerHeightM": (15, 800),
    "thermalStrengthMps": (0.03125, 0.5), "boundaryLayerWindSpeedKmh": (0.5, 4),
    "boundaryLayerWindDirectionDeg": (2, 100), "windShearMpsPerKm": (0.0625, 1), "relativeHumidityPct": (0.5, 30),
    "capeJPerKg": (12.5, 0), "cinJPerKg": (0.5, 10), "lapseRateCPerKm": (0.03125, 5), "lowCloudCoverPct": (0.5, 10),
    "totalCloudCoverPct": (0.5, 20), "precipitationMm": (0.0625, 0), "surfacePressureHpa": (-0.25, 1020),
}


def _sql_number(factor: float, base: float) -> str:
    return f"CAST(k::DOUBLE * {factor}::DOUBLE + {base}::DOUBLE AS VARCHAR)"


def _sql_input(name: str) -> str:
    if name == "convergenceSignal":
        value = _sql_text("CASE k % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'weak' WHEN 2 THEN 'moderate' ELSE 'strong' END")
    elif name == "windByAltitude":
        levels = [
            _sql_object(altitudeMslM=f"'{height}'", directionDeg=_sql_number(1, 200), speedKmh=_sql_number(0.25, speed))
            for height, speed in (("1500.0", 16), ("2500.0", 23))
        ]
        value = f"'[' || {levels[0]} || ',' || {levels[1]} || ']'"
    else:
        value = _sql_number(*_SQL_LINEAR[name])
    gone = "data_status = 'missing'" + (" OR k % 7 = 0" if name == "capeJPerKg" else "")
    given = _sql_object(value=value, dataStatus=_sql_text("data_status"))
    absent = _sql_object(value="'null'", dataStatus="'\"missing\"'", missingReason=_sql_text("'No input for k ' || k"))
    return f"CASE WHEN {gone} THEN {absent} ELSE {given} END"


_SQL_DOCUMENT = _sql_object(
    siteId="site_id",
    siteSlug=_sql_text("slug"),
    forecastDate=_sql_text(day("forecast_date")),
    generatedAt=_sql_text(iso("generated_at")),
    provenance=_SQL_PROVENANCE,
    outputs=_SQL_OUTPUTS,
    forecastInputs=_sql_object(
        provenance="""'{"source":"weather-source","version":"w1"}'""",
        sourceRunAt=_sql_text(iso("generated_at")),
        **{name: _sql_input(name) for name, _label, _unit, _kind in fixed.INPUT_PANEL},
    ),
    topDrivers="""CASE n_drivers WHEN 1 THEN '["Thermal strength"]' WHEN 2 THEN '["Thermal strength","Cloudbase estimate"]'
  ELSE '["Thermal strength","Cloudbase estimate","Wind alignment"]' END""",
)


@query(
    "a04_document_sink",
    with_views(
        ("preds", "sites_x"),
        f"SELECT run_id, {_SQL_DOCUMENT} AS document FROM preds JOIN sites_x ON preds.site_id = sites_x.id",
    ),
)
def document_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.sites(spark, sf_dir).select(F.col("id").alias("site_id"), "slug")
    rows = V.predictions(spark, sf_dir, inputs=True).join(known, "site_id")
    documents = rows.select("run_id", F.struct(*readmodels.detailed_record()).alias("record"))
    return documents.select("run_id", json_records.document_json(F.col("record")).alias("document"))


# --- Sources ---------------------------------------------------------------------


def _first_issue() -> list[Column]:
    first = F.get("issues", 0)
    return [first["path"].alias("path"), first["message"].alias("message")]


def _cut(text: Column) -> Column:
    """Without its last character."""
    return text.substr(F.lit(1), F.length(text) - 1)


@query(
    "a03_document_source",
    with_views(
        ("preds", "sites_x"),
        f"""SELECT run_id, CASE WHEN kind = 8 THEN 'malformed-json' WHEN kind > 0 THEN 'schema-validation' END AS failure_reason,
  CASE kind WHEN 1 THEN 'siteId' WHEN 2 THEN 'siteSlug' WHEN 3 THEN 'forecastDate' WHEN 4 THEN 'generatedAt' WHEN 5 THEN 'topDrivers'
    WHEN 6 THEN 'topDrivers.1' WHEN 7 THEN 'provenance.source' WHEN 9 THEN '' END AS path,
  CASE WHEN kind = 0 THEN site_id END AS site_id, CASE WHEN kind = 0 AND data_status <> 'missing' THEN p100 END AS p100,
  CASE WHEN kind = 0 THEN n_drivers END AS n_drivers
FROM (SELECT *, run_id % 10 AS kind FROM preds) t JOIN sites_x ON t.site_id = sites_x.id""",
    ),
)
def document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text: seven kinds of damage to fields, one cut short, one with another key."""
    kind = F.col("run_id") % 10
    record = F.struct(*schemas.FORECAST_DOCUMENT.names)
    documents = C.damaged_documents(V.predictions(spark, sf_dir, inputs=True), V.sites(spark, sf_dir))
    written = documents.select("run_id", json_records.document_json(record).alias("text"))
    other = F.concat(F.lit('{"x":null,'), F.col("text").substr(F.lit(2), F.length("text")))
    raw = written.select(
        "run_id", F.when(kind == 8, _cut(F.col("text"))).when(kind == 9, other).otherwise(F.col("text")).alias("raw")
    )
    parsed = json_records.parse_forecast_documents(raw, "raw")
    good = F.col("failure_reason").isNull()
    return parsed.select(
        "run_id", "failure_reason", F.get("issues", 0)["path"].alias("path"), F.when(good, F.col("siteId")).alias("site_id"),
        F.when(good, F.col("outputs.chance100KmPct.value")).alias("p100"),
        F.when(good, F.size("topDrivers")).alias("n_drivers"),
    )


def _sql_outcome(kinds: dict[int, tuple[str, str, str]], malformed: int) -> str:
    """failure_reason, path and message by ``kind``: a condition, a path and a message each."""
    case = lambda pick: " ".join(f"WHEN kind = {k} AND ({v[0]}) THEN {pick(v)}" for k, v in kinds.items())
    text = lambda value: value if value.startswith("'") else f"'{value}'"
    reason = f"CASE WHEN kind = {malformed} THEN '{json_records.MALFORMED}' {case(lambda v: f"'{json_records.SCHEMA}'")} END"
    return f"""{reason} AS failure_reason, CASE {case(lambda v: text(v[1]))} END AS path,
  CASE {case(lambda v: text(v[2]))} END AS message"""


_SUMMARIES_OUTCOME = _sql_outcome(
    {
        0: ("true", "", fixed.WRONG_SHAPE),
        1: ("true", "summaries.0", fixed.WRONG_SHAPE),
        2: ("any_gone", "'summaries.' || first_gone || '.availability'", fixed.WRONG_WORD),
        3: ("true", "forecastDate", fixed.DATE_REAL_MESSAGE),
        4: ("true", "summaries.0.forecastDate", fixed.SUMMARY_DATE_MESSAGE),
        6: ("true", "summaries", fixed.WRONG_COUNT),
    },
    5,
)


@query(
    "a03_summaries_source",
    with_views(
        R.SUMMARY_VIEWS,
        f"""SELECT request_id, failure_reason, path, message, CASE WHEN failure_reason IS NULL THEN n END AS n_summaries,
  CASE WHEN failure_reason IS NULL THEN n_given END AS n_available
FROM (SELECT *, {_SUMMARIES_OUTCOME} FROM bodies) t""",
        **R.SUMMARY_CHAIN,
        bodies="""SELECT request_id, request_id % 9 AS kind, count(*) AS n, count_if(run_id IS NOT NULL) AS n_given,
  bool_or(run_id IS NULL) AS any_gone, min(CASE WHEN run_id IS NULL THEN pos END) AS first_gone FROM sums GROUP BY request_id""",
    ),
)
def summaries_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with other keys, types, words, dates or counts, or cut short."""
    kind, text = F.col("request_id") % 9, F.col("body")
    date = r'^\{"forecastDate":"[0-9-]+"'
    raw = (
        F.when(kind == 0, F.regexp_replace(text, r"^\{", '{"extra":1,'))
        .when(kind == 1, F.regexp_replace(text, r'"siteId":(\d+)', r'"siteId":"$1"'))
        .when(kind == 2, F.replace(text, F.lit('"availability":"missing"'), F.lit('"availability":"omitted"')))
        .when(kind == 3, F.regexp_replace(text, date, '{"forecastDate":"2026-02-30"'))
        .when(kind == 4, F.regexp_replace(text, date, '{"forecastDate":"2031-01-01"'))
        .when(kind == 5, _cut(text))
        .when(kind == 6, F.regexp_replace(text, r'"summaries":.*$', '"summaries":[]}'))
        .otherwise(text)
    )
    bodies = responses.summaries_responses(R.summaries(spark, sf_dir)).select("request_id", raw.alias("raw"))
    parsed = responses.parse_summaries_responses(bodies, "raw")
    listed = F.col("record.summaries")
    given = F.size(F.filter(listed, lambda item: item["availability"] == "available"))
    return parsed.select(
        "request_id", "failure_reason", *_first_issue(),
        F.when(listed.isNotNull(), F.size(listed)).cast("long").alias("n_summaries"),
        F.when(listed.isNotNull(), given).cast("long").alias("n_available"),
    )


_DAYS_OUTCOME = _sql_outcome(
    {
        0: ("true", "", fixed.WRONG_SHAPE),
        1: ("true", "timeZone", fixed.WRONG_ZONE),
        2: ("true", "days.0.forecastDate", "'Expected forecast date ' || " + day("today - 1") + " || '.'"),
        3: ("true", "days", fixed.WRONG_COUNT),
        4: ("n_given > 0", "'days.' || first_given || '.chance100KmPct.value'", fixed.WRONG_NUMBER),
        5: ("n_given > 0", "'days.' || first_given", fixed.WRONG_SHAPE),
    },
    6,
)


@query(
    "a03_days_source",
    with_views(
        R.SUMMARY_VIEWS,
        f"""SELECT request_id, failure_reason, path, message, CASE WHEN failure_reason IS NULL THEN site_id END AS site_id,
  CASE WHEN failure_reason IS NULL THEN sum_p100 END AS sum_p100
FROM (SELECT *, {_DAYS_OUTCOME} FROM bodies) t""",
        slots=R.SQL_SLOTS,
        bodies="""SELECT request_id, request_id % 8 AS kind, site_id, today, count_if(found AND data_status <> 'missing') AS n_given,
  min(CASE WHEN found AND data_status <> 'missing' THEN pos END) AS first_given,
  CAST(sum(CASE WHEN found AND data_status <> 'missing' THEN round(p100 * 100) END) AS BIGINT) AS sum_p100
FROM slots GROUP BY request_id, site_id, today""",
    ),
)
def days_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with other keys, zones, dates, counts or values, or cut short."""
    kind, text = F.col("request_id") % 8, F.col("body")
    today = F.to_date(F.get_json_object("body", "$.todayDate"))
    shifted = F.concat(F.lit('"todayDate":"'), iso_date(F.date_add(today, 1)), F.lit('"'))
    raw = (
        F.when(kind == 0, F.replace(text, F.lit('"timeZone"'), F.lit('"time zone"')))
        .when(kind == 1, F.replace(text, F.lit(fixed.FORECAST_ZONE), F.lit("UTC")))
        .when(kind == 2, F.regexp_replace(text, F.lit(r'"todayDate":"[0-9-]+"'), shifted))
        .when(kind == 3, F.regexp_replace(text, r'"days":\[', r'"days":[{"forecastDate":"2024-01-01","chance100KmPct":{"value":null,"dataStatus":"missing","confidence":null,"missingReason":"x"}},'))
        .when(kind == 4, F.regexp_replace(text, r'"value":[0-9][0-9.E-]*', '"value":100.5'))
        .when(kind == 5, F.regexp_replace(text, r'"value":([0-9][0-9.E-]*)', '"value":"$1"'))
        .when(kind == 6, _cut(text))
        .otherwise(text)
    )
    bodies = responses.days_responses(R.preview(spark, sf_dir)).select("request_id", raw.alias("raw"))
    parsed = responses.parse_days_responses(bodies, "raw")
    values = F.transform("record.days", lambda item: F.round(item["chance100KmPct"]["value"] * 100).cast("long"))
    given = F.filter(values, lambda value: value.isNotNull())
    total = F.aggregate(given, F.lit(0).cast("long"), lambda a, b: a + b)
    return parsed.select(
        "request_id", "failure_reason", *_first_issue(), F.col("record.siteId").alias("site_id"),
        F.when(F.size(given) > 0, total).alias("sum_p100"),
    )


@query(
    "a03_sites_source",
    f"""SELECT pos, failure_reason, path, message, CASE WHEN failure_reason IS NULL THEN 2 END AS n_sites FROM (
SELECT pos, {_sql_outcome({
        0: ("true", "", fixed.WRONG_SHAPE), 1: ("true", "sites.1.slug", fixed.WRONG_SLUG),
        3: ("true", "sites.1.slug", fixed.WRONG_SLUG), 4: ("true", "sites.1.slug", fixed.WRONG_SLUG),
        5: ("true", "sites.1.latitude", fixed.WRONG_NUMBER), 6: ("true", "sites.1", fixed.WRONG_SHAPE),
        7: ("true", "sites.1", fixed.WRONG_SHAPE), 9: ("true", "sites.1.name", fixed.WRONG_NAME),
        10: ("true", "sites.1", fixed.WRONG_SHAPE), 12: ("true", "sites.1.id", fixed.WRONG_ID)}, 11)}
FROM (SELECT c_custkey AS pos, CASE WHEN c_custkey IN (1, 2) THEN 12 ELSE c_custkey % 12 END AS kind FROM customer) s) t""",
)
def sites_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of a valid and a candidate site each; values that JSON has no number for are texts or null."""
    kind = F.col("pos") % 12
    good = F.struct(
        F.lit(1).cast("long").alias("id"), F.lit("first-site").alias("slug"), F.lit("First").alias("name"),
        F.lit(42.5).alias("latitude"), F.lit(-23.25).alias("longitude"),
    )
    candidates = C.candidate_sites(spark, sf_dir)
    body = responses.sites_response_json(F.array(good, F.struct(*schemas.SITE.names)))
    raw = F.when(kind == 0, F.concat(F.lit("["), body, F.lit("]"))).when(kind == 11, _cut(body)).otherwise(body)
    parsed = responses.parse_sites_responses(candidates.select("pos", raw.alias("raw")), "raw")
    count = F.when(F.col("record").isNotNull(), F.size("record.sites"))
    return parsed.select("pos", "failure_reason", *_first_issue(), count.alias("n_sites"))


@query(
    "a43_problem_body",
    with_views(
        ("ev",),
        f"""SELECT event_id, failure_reason, path, message, CASE WHEN failure_reason IS NULL THEN code END AS code,
  CASE WHEN failure_reason IS NULL AND k % 3 > 0 THEN k % 3 END AS n_issues FROM (SELECT *, {_sql_outcome({
        1: ("true", "title", "'Expected title to match problem code ' || code || '.'"),
        2: ("true", "status", "'Expected status to match problem code ' || code || '.'"),
        3: ("true", "type", "'Expected type to match problem code ' || code || '.'"),
        4: ("true", "detail", fixed.WRONG_NAME), 5: ("true", "code", fixed.WRONG_WORD), 6: ("true", "", fixed.WRONG_SHAPE)}, 7)}
FROM (SELECT event_id, k, event_id % 7 AS kind, {C.CODE_SQL} AS code FROM ev) s) t""",
    ),
)
def problem_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems with no, one or two issues, written and read; of some the status is a text."""
    listed = F.array(
        *[F.struct(F.lit(path).alias("path"), F.lit("Message.").alias("message")) for path in ("siteSlug", "")]
    )
    more = V.event_rows(spark, sf_dir).select(
        "event_id", F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("requestId"),
        F.when(F.col("k") % 3 > 0, F.slice(listed, F.lit(1), F.col("k") % 3)).alias("issues"),
    )
    rows = C.problem_rows(spark, sf_dir).join(more, "event_id")
    text = responses.problem_json(F.struct(*schemas.PROBLEM.names))
    odd = F.regexp_replace("text", r'"status":(\d+)', r'"status":"$1"')
    written = rows.select("event_id", text.alias("text"))
    raw = written.select("event_id", F.when(F.col("event_id") % 7 == 6, odd).otherwise(F.col("text")).alias("raw"))
    parsed = responses.parse_problems(raw, "raw", C.NAMESPACE)
    own = F.when(F.col("record.issues").isNotNull(), F.size("record.issues"))
    return parsed.select(
        "event_id", "failure_reason", *_first_issue(), F.col("record.code").alias("code"), own.alias("n_issues")
    )

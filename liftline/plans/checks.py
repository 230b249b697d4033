"""Roll-ups, catalog checks, contract rules and page-view selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline.functions.calendar import iso_date, shift_days
from liftline.functions.issues import issue_list
from liftline.functions.metrics import input_metric, missing_metric
from liftline.operators import catalog as catalog_ops
from liftline.operators import panels, readmodels, rules, selection
from liftline.plans import reads as R
from liftline.plans import views as V
from liftline.plans.oracle_views import day, integer_text, number_text, with_views
from liftline.plans.registry import query

# --- Roll-ups --------------------------------------------------------------------


@query(
    "a26_status_rollup",
    with_views(
        ("runs",),
        """SELECT run_id, CASE WHEN st100 = stcb AND st100 = st200 AND st100 = st300 AND st100 = strisk
  THEN st100 ELSE 'mixed' END AS status FROM mixed""",
        mixed=R.SQL_MIXED,
    ),
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mixed_outputs(spark, sf_dir).select(
        "run_id", panels.output_status(F.col("outputs")).alias("status")
    )


@query(
    "a27_input_status_rollup",
    with_views(
        ("preds",),
        """SELECT run_id, CASE WHEN k % 7 = 0 AND data_status <> 'missing' THEN 'mixed' ELSE data_status END AS status FROM preds""",
    ),
)
def input_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.predictions(spark, sf_dir, inputs=True).select(
        "run_id", panels.input_status(F.col("inputs")).alias("status")
    )


@query(
    "a28_confidence_rollup",
    with_views(
        ("runs",),
        """SELECT run_id, CASE WHEN data_status = 'missing' THEN 'unavailable'
    WHEN lvcb = confidence_level THEN confidence_level ELSE 'mixed' END AS level,
  CASE WHEN data_status = 'missing' THEN '' WHEN ntcb = confidence_note THEN confidence_note
    ELSE confidence_note || '|' || ntcb END AS notes FROM mixed""",
        mixed=R.SQL_MIXED,
    ),
)
def confidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = R.mixed_outputs(spark, sf_dir).select(
        "run_id", panels.output_confidence(F.col("outputs")).alias("c")
    )
    return rolled.select("run_id", "c.level", F.array_join("c.notes", "|").alias("notes"))


# --- Catalog ---------------------------------------------------------------------


@query("a29_default_site", with_views(("sites_x",), "SELECT * FROM sites_x ORDER BY id, slug LIMIT 1"))
def default_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.default_site(V.sites(spark, sf_dir))


@query(
    "a30_bounding_box",
    with_views(
        ("sites_x",),
        "SELECT min(latitude) AS south, min(longitude) AS west, max(latitude) AS north, max(longitude) AS east FROM sites_x",
    ),
)
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.bounding_box(V.sites(spark, sf_dir))


_DIRTY_SQL = """SELECT c_custkey AS pos, c_custkey % 97 + 1 AS id,
  'site-' || CAST(c_custkey % 130 AS VARCHAR) AS slug FROM customer"""


@query(
    "a31_duplicate_keys",
    f"""SELECT pos, id, slug, CASE WHEN seen_id > 1 THEN 'Duplicate site ID: ' || id
  ELSE 'Duplicate site slug: ' || slug END AS message FROM (
SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS seen_id,
  row_number() OVER (PARTITION BY slug ORDER BY pos) AS seen_slug FROM ({_DIRTY_SQL}) c) t
WHERE seen_id > 1 OR seen_slug > 1""",
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    dirty = V.table(spark, sf_dir, "customer").select(
        key.alias("pos"),
        (key % 97 + 1).alias("id"),
        F.concat(F.lit("site-"), (key % 130).cast("string")).alias("slug"),
    )
    return catalog_ops.duplicate_rows(dirty)


# Envelopes of four items from each event: known and unknown order, repeats, other dates.
def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, user = F.col("k"), F.col("user_id")
    ids = [user + 1, k.cast("bigint") + 1, k.cast("bigint") + 1 + k % 3, user + k % 2 + 1]
    slugs = [ids[0], ids[1], ids[2], user]
    date = F.to_date("ts")
    items = [
        F.struct(
            id_.alias("siteId"),
            F.concat(F.lit("site-"), slug.cast("string")).alias("siteSlug"),
            iso_date(shift_days(date, (k % 6 == i).cast("int"))).alias("forecastDate"),
        )
        for i, (id_, slug) in enumerate(zip(ids, slugs))
    ]
    return V.event_rows(spark, sf_dir).select(
        "event_id", iso_date(date).alias("response_date"), F.array(*items).alias("summaries")
    )


_ENVELOPE_SQL = """SELECT event_id, CAST(ts AS DATE) AS d, i.pos, i.site_id, i.slug,
  CAST(ts AS DATE) + CAST(CASE WHEN k % 6 = i.pos THEN 1 ELSE 0 END AS INT) AS item_date
FROM ev CROSS JOIN LATERAL (VALUES (0, user_id + 1, user_id + 1), (1, k + 1, k + 1),
  (2, k + 1 + k % 3, k + 1 + k % 3), (3, user_id + k % 2 + 1, user_id)) AS i(pos, site_id, slug)"""


@query(
    "a32_ordered_batch_check",
    with_views(
        ("ev",),
        """SELECT event_id, 'summaries.' || pos || '.' || u.field AS path, u.message FROM (
SELECT *, row_number() OVER (PARTITION BY event_id, site_id ORDER BY pos) AS n_id,
  row_number() OVER (PARTITION BY event_id, slug ORDER BY pos) AS n_slug,
  lag(site_id, 1, 0) OVER (PARTITION BY event_id ORDER BY pos) AS before_id FROM env) t
CROSS JOIN LATERAL (VALUES
  (item_date <> d, 'forecastDate', 'Expected the summary date to match the response date.'),
  (n_id > 1, 'siteId', 'Expected one summary per site ID.'),
  (n_slug > 1, 'siteSlug', 'Expected one summary per site slug.'),
  (site_id <= before_id, 'siteId', 'Expected summaries to be ordered by ascending site ID.')) AS u(broken, field, message)
WHERE u.broken""",
        env=_ENVELOPE_SQL,
    ),
)
def ordered_batch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _envelopes(spark, sf_dir).withColumn(
        "issues", rules.summary_batch_issues(F.col("summaries"), F.col("response_date"))
    )
    return rules.issue_rows(checked, ["event_id"]).drop("issue_pos")


# --- Rules -----------------------------------------------------------------------


def candidate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    kind = key % 12
    slug = F.concat(F.lit("site-"), key.cast("string"))
    odd = (
        F.when(kind == 1, F.concat(F.lit("Site-"), key.cast("string")))
        .when(kind == 2, F.concat(F.lit("\t"), slug, F.lit(" ")))
        .when(kind == 3, F.lit("double--dash"))
        .when(kind == 4, F.repeat(F.lit("a"), F.lit(81)))
        .otherwise(slug)
    )
    latitude = F.when(kind == 5, F.lit(90.5)).when(kind == 6, F.lit(float("nan"))).otherwise(F.lit(42.0))
    longitude = F.when(kind == 7, F.lit(float("-inf"))).when(kind == 8, F.lit(-180.0)).otherwise(F.lit(23.5))
    return V.table(spark, sf_dir, "customer").select(
        key.alias("pos"), (key - 2).alias("id"), odd.alias("slug"),
        F.when(kind == 9, " \t").otherwise(F.col("c_name")).alias("name"),
        latitude.alias("latitude"),
        F.when(kind != 10, longitude).alias("longitude"),
    )


@query(
    "a33_site_rules",
    f"""SELECT pos, u.path, u.message FROM (SELECT c_custkey AS pos, c_custkey - 2 AS id, c_custkey % 12 AS kind FROM customer) t
CROSS JOIN LATERAL (VALUES (id < 1, 'id', '{fixed.WRONG_ID}'), (kind IN (1, 3, 4), 'slug', '{fixed.WRONG_SLUG}'),
  (kind = 9, 'name', '{fixed.WRONG_NAME}'), (kind IN (5, 6), 'latitude', '{fixed.WRONG_NUMBER}'),
  (kind IN (7, 10), 'longitude', '{fixed.WRONG_NUMBER}')) AS u(broken, path, message) WHERE u.broken""",
)
def site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = candidate_sites(spark, sf_dir).withColumn("issues", rules.site_issues())
    return rules.issue_rows(checked, ["pos"]).drop("issue_pos")


# Date texts of many kinds, one per event.
def _date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, date = F.col("event_id") % 9, F.to_date("ts")
    text = (
        F.when(kind == 0, F.date_format(date, "yyyy-M-d"))
        .when(kind == 1, F.concat(F.date_format(date, "yyyy"), F.lit("-02-30")))
        .when(kind == 2, F.concat(F.lit("00"), F.date_format(date, "dd-MM-dd")))
        .when(kind == 3, F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T00:00")))
        .when(kind == 4, F.lit("2028-02-29"))
        .when(kind == 5, F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("\n")))
        .when(kind == 6, F.concat(F.lit("2024-"), F.lpad((F.col("k") % 20).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("k") % 33).cast("string"), 2, "0")))
        .when(kind != 7, F.date_format(date, "yyyy-MM-dd"))
    )
    return V.event_rows(spark, sf_dir).select("event_id", text.alias("date_text"))


_DATE_TEXT_SQL = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN strftime(ts, '%Y-%-m-%-d') WHEN 1 THEN strftime(ts, '%Y') || '-02-30'
  WHEN 2 THEN '00' || strftime(ts, '%d-%m-%d') WHEN 3 THEN strftime(ts, '%Y-%m-%d') || 'T00:00' WHEN 4 THEN '2028-02-29'
  WHEN 5 THEN strftime(ts, '%Y-%m-%d') || chr(10)
  WHEN 6 THEN '2024-' || lpad(CAST(k % 20 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 33 AS VARCHAR), 2, '0')
  WHEN 8 THEN strftime(ts, '%Y-%m-%d') END AS date_text FROM ev"""


@query(
    "a34_date_rule",
    with_views(
        ("ev",),
        f"""SELECT event_id, CASE WHEN date_text IS NULL THEN '{fixed.REQUIRED}'
  WHEN NOT regexp_full_match(date_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN '{fixed.DATE_FORMAT_MESSAGE}'
  WHEN TRY_CAST(date_text AS DATE) IS NULL OR year(TRY_CAST(date_text AS DATE)) < 100 THEN '{fixed.DATE_REAL_MESSAGE}' END AS message
FROM texts""",
        texts=_DATE_TEXT_SQL,
    ),
)
def date_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _date_texts(spark, sf_dir).select(
        "event_id", rules.date_issue(F.col("date_text"), "date")[0]["message"].alias("message")
    )


# Metrics between the branches: one kind of damage per value of event_id % 10.
def _damaged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 10
    value = (
        F.when(kind == 1, F.lit(101.0)).when(kind == 2, F.lit(-0.5)).when(kind == 3, F.lit(float("nan")))
        .when(kind == 4, F.lit(0.0)).when(kind == 8, F.lit(100.0)).when(kind.isin(5, 6), F.lit(None))
        .otherwise(F.least("value", F.lit(100.0)))
    )
    status = F.when(kind.isin(4, 5, 6), "missing").when(kind == 9, "guessed").otherwise("mock")
    level = F.when(~kind.isin(4, 5, 6, 7), "low")
    return V.event_rows(spark, sf_dir).select(
        "event_id",
        F.struct(
            value.alias("value"), status.alias("dataStatus"),
            F.when(level.isNotNull(), F.struct(level.alias("level"), F.lit("note").alias("note"))).alias("confidence"),
            F.when(kind.isin(4, 5), "No run.").when(kind == 6, "  ").alias("missingReason"),
        ).alias("m"),
    )


@query(
    "a35_output_metric_union",
    """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'ok' WHEN 5 THEN 'ok' WHEN 8 THEN 'ok'
  WHEN 1 THEN 'value' WHEN 2 THEN 'value' WHEN 3 THEN 'value' WHEN 9 THEN 'dataStatus' ELSE 'branch' END AS verdict FROM events""",
)
def output_metric_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged metric stands in for the 100+ km chance of a complete output."""
    word = F.struct(
        F.lit("low").alias("value"), F.lit("mock").alias("dataStatus"),
        F.struct(F.lit("low").alias("level"), F.lit("note").alias("note")).alias("confidence"),
        F.lit(None).cast("string").alias("missingReason"),
    )
    gone = missing_metric("double", F.lit("No run."))
    outputs = F.struct(
        gone.alias("cloudbaseMslM"), F.col("m").alias("chance100KmPct"), gone.alias("chance200KmPct"),
        gone.alias("chance300KmPct"), word.alias("overdevelopmentRisk"),
    )
    rows = _damaged_metrics(spark, sf_dir).select("event_id", outputs.alias("outputs"))
    checked = rows.select("event_id", rules.output_metric_issues(F.col("outputs"), "o").alias("issues"))
    path = F.get("issues", F.lit(0))["path"]
    verdict = (
        F.when(F.size("issues") == 0, "ok")
        .when(F.size("issues") > 1, "several")
        .when(path == "o.chance100KmPct.value", "value")
        .when(path == "o.chance100KmPct.dataStatus", "dataStatus")
        .when(path == "o.chance100KmPct", "branch")
    )
    return checked.select("event_id", verdict.alias("verdict"))


def _damaged_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of runs with one field moved out of its domain for some values of k."""
    k, i = F.col("k"), F.col("inputs")
    mock, reason = F.lit("mock"), F.lit("No input.")
    empty_wind = i["windByAltitude"].withField("value", F.slice(i["windByAltitude"]["value"], 1, 0))
    changed = (
        i.withField("relativeHumidityPct", F.when(k % 11 == 1, input_metric(F.lit(100.5), mock, reason)).otherwise(i["relativeHumidityPct"]))
        .withField("surfacePressureHpa", F.when(k % 11 == 2, input_metric(F.lit(799.0), mock, reason)).otherwise(i["surfacePressureHpa"]))
        .withField("windByAltitude", F.when(k % 11 == 3, empty_wind).otherwise(i["windByAltitude"]))
        .withField("convergenceSignal", F.when(k % 11 == 4, input_metric(F.lit("extreme"), mock, reason, "string")).otherwise(i["convergenceSignal"]))
        .withField("capeJPerKg", F.when(k % 11 == 5, input_metric(F.lit(None), F.lit("missing"), F.lit(" "))).otherwise(i["capeJPerKg"]))
    )
    return V.prediction_runs(spark, sf_dir, inputs=True).select("run_id", "data_status", changed.alias("inputs"))


@query(
    "a36_input_metric_union",
    with_views(
        ("runs",),
        f"""SELECT run_id, u.path, u.message FROM runs CROSS JOIN LATERAL (VALUES
  (k % 11 = 1, 'forecastInputs.relativeHumidityPct.value', '{fixed.WRONG_NUMBER}'),
  (k % 11 = 2, 'forecastInputs.surfacePressureHpa.value', '{fixed.WRONG_NUMBER}'),
  (k % 11 = 3 AND data_status <> 'missing', 'forecastInputs.windByAltitude.value', '{fixed.WRONG_NUMBER}'),
  (k % 11 = 4, 'forecastInputs.convergenceSignal.value', '{fixed.WRONG_NUMBER}'),
  (k % 11 = 5, 'forecastInputs.capeJPerKg', '{fixed.WRONG_BRANCH}')) AS u(broken, path, message) WHERE u.broken""",
    ),
)
def input_metric_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _damaged_inputs(spark, sf_dir).withColumn("issues", rules.input_metric_issues(F.col("inputs")))
    return rules.issue_rows(checked, ["run_id"]).drop("issue_pos")


@query(
    "a37_chance_nesting",
    with_views(
        ("runs",),
        f"""SELECT run_id, u.path, u.message FROM swapped CROSS JOIN LATERAL (VALUES
  (c100 < c200, 'outputs.chance100KmPct.value', '{fixed.CHANCE_100_200_MESSAGE}'),
  (c200 < c300, 'outputs.chance200KmPct.value', '{fixed.CHANCE_200_300_MESSAGE}'),
  (c200 IS NULL AND c100 < c300, 'outputs.chance100KmPct.value', '{fixed.CHANCE_100_300_MESSAGE}')) AS u(broken, path, message)
WHERE u.broken""",
        swapped="""SELECT run_id, CASE k % 5 WHEN 1 THEN p300 WHEN 2 THEN p300 WHEN 3 THEN p200 ELSE p100 END AS c100,
  CASE k % 5 WHEN 1 THEN NULL WHEN 4 THEN p300 ELSE p200 END AS c200,
  CASE k % 5 WHEN 1 THEN p100 WHEN 4 THEN p200 ELSE p300 END AS c300 FROM runs""",
    ),
)
def chance_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swapped chances: each of the three rules is broken by some value of k."""
    kind = F.col("k") % 5
    p100, p200, p300 = F.col("p100"), F.col("p200"), F.col("p300")
    rows = V.prediction_runs(spark, sf_dir).select(
        "run_id", "k", "data_status", "confidence", "cloudbase_msl_m", "od_risk",
        F.when(kind.isin(1, 2), p300).when(kind == 3, p200).otherwise(p100).alias("p100"),
        F.when(kind == 4, p300).otherwise(p200).alias("p200"),
        F.when(kind == 1, p100).when(kind == 4, p200).otherwise(p300).alias("p300"),
    )
    outputs = readmodels.outputs()
    gone = missing_metric("double", F.lit("No 200+ km estimate."))
    shaped = rows.withColumn("o", outputs).withColumn(
        "o", F.col("o").withField("chance200KmPct", F.when(kind == 1, gone).otherwise(F.col("o.chance200KmPct")))
    )
    checked = shaped.withColumn("issues", rules.nesting_issues(F.col("o")))
    return rules.issue_rows(checked, ["run_id"]).drop("issue_pos")


def damaged_documents(runs: DataFrame, sites: DataFrame) -> DataFrame:
    """Detailed documents of runs with damage by run_id % 10."""
    rows = runs.join(sites.select(F.col("id").alias("site_id"), "slug"), "site_id")
    kind = F.col("run_id") % 10
    docs = rows.select("run_id", *readmodels.detailed_record())
    blank = F.array(F.lit("Thermal strength"), F.lit(" "))
    return docs.withColumns(
        {
            "siteId": F.when(kind == 1, F.lit(0)).otherwise(F.col("siteId")),
            "siteSlug": F.when(kind == 2, F.upper("siteSlug")).otherwise(F.col("siteSlug")),
            "forecastDate": F.when(kind == 3, "2026-02-30").otherwise(F.col("forecastDate")),
            "generatedAt": F.when(kind == 4, F.replace("generatedAt", F.lit("Z"), F.lit("+02:00"))).otherwise(F.col("generatedAt")),
            "topDrivers": F.when(kind == 5, F.slice("topDrivers", 1, 0)).when(kind == 6, blank).otherwise(F.col("topDrivers")),
            "provenance": F.when(kind == 7, F.col("provenance").withField("source", F.lit(" "))).otherwise(F.col("provenance")),
        }
    )


@query(
    "a38_record_rules",
    with_views(
        ("runs", "sites_x"),
        f"""SELECT run_id, u.path, u.message FROM runs JOIN sites_x ON runs.site_id = sites_x.id CROSS JOIN LATERAL (VALUES
  (1, 'siteId', '{fixed.WRONG_ID}'), (2, 'siteSlug', '{fixed.WRONG_SLUG}'), (3, 'forecastDate', '{fixed.DATE_REAL_MESSAGE}'),
  (4, 'generatedAt', '{fixed.WRONG_INSTANT}'), (5, 'topDrivers', '{fixed.WRONG_COUNT}'),
  (6, 'topDrivers.1', '{fixed.WRONG_NAME}'), (7, 'provenance.source', '{fixed.WRONG_NAME}')) AS u(kind, path, message)
WHERE run_id % 10 = u.kind""",
    ),
)
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = damaged_documents(V.prediction_runs(spark, sf_dir, inputs=True), V.sites(spark, sf_dir))
    checked = documents.withColumn("issues", rules.record_issues())
    return rules.issue_rows(checked, ["run_id"]).drop("issue_pos")


@query(
    "a39_days_strip_rules",
    with_views(
        ("ev",),
        f"""SELECT event_id, path, message FROM (
SELECT event_id, 'timeZone' AS path, '{fixed.WRONG_ZONE}' AS message FROM ev WHERE k % 8 = 1
UNION ALL SELECT event_id, 'days', '{fixed.WRONG_COUNT}' FROM ev WHERE k % 8 IN (2, 3)
UNION ALL SELECT event_id, 'days.' || i || '.forecastDate', 'Expected forecast date ' || {day("CAST(ts AS DATE) + CAST(i - 2 AS INT)")} || '.'
  FROM ev CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS i) n WHERE k % 8 = 4 OR (k % 8 = 5 AND i IN (0, 4))) t""",
    ),
)
def days_strip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips with another zone, too few or too many days, shifted days, swapped ends."""
    kind, today = F.col("k") % 8, F.to_date("ts")
    window = F.transform(F.sequence(F.date_add(today, -2), F.date_add(today, 2)), iso_date)
    longer = F.transform(F.sequence(F.date_add(today, -2), F.date_add(today, 3)), iso_date)
    shifted = F.transform(F.sequence(F.date_add(today, -3), F.date_add(today, 1)), iso_date)
    swapped = F.array(window[4], window[1], window[2], window[3], window[0])
    days = (
        F.when(kind == 2, F.slice(window, 1, 4)).when(kind == 3, longer).when(kind == 4, shifted)
        .when(kind == 5, swapped).otherwise(window)
    )
    strips = V.event_rows(spark, sf_dir).select(
        "event_id", F.when(kind == 1, "UTC").otherwise("Europe/Sofia").alias("zone"),
        iso_date(today).alias("today"), days.alias("days"),
    )
    checked = strips.withColumn("issues", rules.strip_issues(F.col("zone"), F.col("today"), F.col("days")))
    return rules.issue_rows(checked, ["event_id"]).drop("issue_pos")


# Slug lists of eight kinds.
def _slug_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, base = F.col("k") % 8, F.col("site_slugs")
    eight = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("s"), i.cast("string"))), ",")
    text = (
        F.when(kind == 1, F.concat(base, F.lit(",")))
        .when(kind == 2, F.upper(base))
        .when(kind == 3, F.concat(F.lit("\t"), F.col("slug"), F.lit(", "), F.col("slug")))
        .when(kind == 4, eight)
        .when(kind == 5, F.lit(""))
        .when(kind != 6, base)
    )
    date = F.when(F.col("k") % 9 == 8, "2024-02-30").otherwise(F.col("request_date").cast("string"))
    return V.requests(spark, sf_dir).select("request_id", text.alias("site_slugs"), date.alias("date_text"))


_LIST_SQL = """SELECT request_id, k, slug, slug2, request_date, CASE k % 8 WHEN 1 THEN [slug, slug2, '']
  WHEN 2 THEN [upper(slug), upper(slug2)] WHEN 3 THEN [slug, slug] WHEN 4 THEN ['s1', 's2', 's3', 's4', 's5', 's6', 's7', 's8']
  WHEN 5 THEN [''] WHEN 6 THEN NULL ELSE [slug, slug2] END AS items FROM reqs"""
_LIST_ISSUES_SQL = f"""SELECT request_id, 'siteSlugs.' || (i.n - 1) AS path, '{fixed.WRONG_SLUG}' AS message
  FROM lists CROSS JOIN LATERAL (SELECT unnest(range(1, len(items) + 1)) AS n) i
  WHERE NOT regexp_full_match(items[i.n], '[a-z0-9]+(-[a-z0-9]+)*')
UNION ALL SELECT request_id, 'siteSlugs', '{fixed.WRONG_COUNT}' FROM lists WHERE len(items) > 7
UNION ALL SELECT request_id, 'siteSlugs', '{fixed.UNIQUE_SLUGS_MESSAGE}' FROM lists
  WHERE len(list_distinct(items)) < len(items) AND len([x for x in items if NOT regexp_full_match(x, '[a-z0-9]+(-[a-z0-9]+)*')]) = 0
UNION ALL SELECT request_id, 'siteSlugs', '{fixed.REQUIRED}' FROM lists WHERE items IS NULL"""


@query(
    "a40_slug_list_parse",
    with_views(
        ("reqs",),
        """SELECT l.request_id, array_to_string(items, '|') AS slugs, coalesce(n, 0) AS n_issues FROM lists l
LEFT JOIN (SELECT request_id, count(*) AS n FROM bad GROUP BY request_id) b ON b.request_id = l.request_id""",
        lists=_LIST_SQL,
        bad=_LIST_ISSUES_SQL,
    ),
)
def slug_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _slug_lists(spark, sf_dir).withColumn("slugs", rules.parse_slug_list(F.col("site_slugs")))
    return parsed.select(
        "request_id", F.array_join("slugs", "|").alias("slugs"),
        F.size(rules.slug_list_issues(F.col("slugs"))).cast("bigint").alias("n_issues"),
    )


@query(
    "a41_unknown_field_rule",
    with_views(
        ("ev",),
        """SELECT event_id, '$' AS path, 'Unrecognized field: ' || CASE k % 4 WHEN 1 THEN 'x' ELSE 'x, y' END AS message
FROM ev WHERE k % 4 IN (1, 2)""",
    ),
)
def unknown_field_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("k") % 4
    extra = F.when(kind == 1, ', "x": 1}').when(kind == 2, ', "y": null, "x": {"k": 1}}').otherwise("}")
    raw = V.event_rows(spark, sf_dir).select(
        "event_id", F.concat(F.regexp_replace("props", r"\}\s*\z", ""), extra).alias("raw")
    )
    checked = raw.withColumn("issues", issue_list(rules.unknown_field_issue(F.col("raw"), ["k"])))
    return rules.issue_rows(checked, ["event_id"]).drop("issue_pos")


@query(
    "a42_issue_table",
    with_views(
        ("reqs",),
        f"""SELECT * FROM bad UNION ALL SELECT request_id, 'date', '{fixed.DATE_REAL_MESSAGE}' FROM reqs WHERE k % 9 = 8""",
        lists=_LIST_SQL,
        bad=_LIST_ISSUES_SQL,
    ),
)
def issue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = rules.rejected_summary_requests(_slug_lists(spark, sf_dir))
    return rules.issue_rows(rejected, ["request_id"]).drop("issue_pos")


NAMESPACE = "liftline"


def problem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem rows of all codes; some disagree with their code."""
    codes = F.array(*[F.lit(row[0]) for row in fixed.PROBLEM_CODES])
    kind = F.col("event_id") % 7
    rows = V.event_rows(spark, sf_dir).select(
        "event_id", F.get(codes, (F.col("k") % 6).cast("int")).alias("code"),
    )
    filled = rules.with_problem(rows, "code", NAMESPACE)
    return filled.withColumns(
        {
            "title": F.when(kind == 1, "Other title").otherwise(F.col("title")),
            "status": F.when(kind.isin(1, 2), 418).otherwise(F.col("status")),
            "type": F.when(kind == 3, "about:blank").otherwise(F.col("type")),
            "detail": F.when(kind == 4, " ").otherwise(F.lit("Detail.")),
            "code": F.when(kind == 5, "OTHER").otherwise(F.col("code")),
        }
    )


CODE_SQL = "(['VALIDATION_ERROR', 'SITE_NOT_FOUND', 'FORECAST_NOT_FOUND', 'ROUTE_NOT_FOUND', 'RESPONSE_CONTRACT_ERROR', 'INTERNAL_SERVER_ERROR'])[k % 6 + 1]"


@query(
    "a43_problem_codes",
    with_views(
        ("ev",),
        f"""SELECT event_id, u.path, u.message FROM (SELECT event_id, event_id % 7 AS kind, {CODE_SQL} AS code FROM ev) t
CROSS JOIN LATERAL (VALUES (kind = 1, 'title', 'Expected title to match problem code ' || code || '.'),
  (kind IN (1, 2), 'status', 'Expected status to match problem code ' || code || '.'),
  (kind = 3, 'type', 'Expected type to match problem code ' || code || '.'),
  (kind = 4, 'detail', '{fixed.WRONG_NAME}'), (kind = 5, 'code', '{fixed.WRONG_WORD}')) AS u(broken, path, message) WHERE u.broken""",
    ),
)
def problem_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = problem_rows(spark, sf_dir).withColumn("issues", rules.problem_issues(NAMESPACE))
    return rules.issue_rows(checked, ["event_id"]).drop("issue_pos")


@query(
    "a43_problem_envelope",
    with_views(
        ("ev",),
        f"""SELECT event_id, 'requestId' AS path, '{fixed.WRONG_REQUEST_ID}' AS message FROM ev WHERE event_id % 8 IN (1, 2, 3, 4)
UNION ALL SELECT event_id, 'issues.1.message', '{fixed.WRONG_NAME}' FROM ev WHERE event_id % 8 IN (4, 5)
UNION ALL SELECT event_id, 'issues.0.path', '{fixed.REQUIRED}' FROM ev WHERE event_id % 8 = 6""",
    ),
)
def problem_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request ids that are empty, too long, spaced or absent; issues without a message or path."""
    kind = F.col("event_id") % 8
    request = (
        F.when(kind == 1, "").when(kind == 2, F.repeat(F.lit("a"), 129)).when(kind == 3, "a b")
        .when(kind == 4, F.lit(None).cast("string")).otherwise(F.concat(F.lit("req-1:"), F.col("event_id").cast("string")))
    )
    path = F.when(kind != 6, "siteSlug")
    message = F.when(~kind.isin(4, 5), "Message.").otherwise(" ")
    issues = F.array(
        F.struct(path.alias("path"), F.lit("Message.").alias("message")),
        F.struct(F.lit("").alias("path"), message.alias("message")),
    )
    rows = V.event_rows(spark, sf_dir).select(
        "event_id", request.alias("request_id"), F.when(kind != 7, issues).alias("issues")
    )
    checked = rows.select("event_id", rules.problem_envelope_issues().alias("found"))
    return rules.issue_rows(checked, ["event_id"], "found").drop("issue_pos")


def _site_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail and days requests; some padded, some with a broken slug or date."""
    kind = F.col("k") % 6
    slug = (
        F.when(kind == 1, F.concat(F.lit(" \t"), F.col("slug"), F.lit(" "))).when(kind == 2, F.upper("slug"))
        .when(kind == 3, F.lit(None).cast("string")).otherwise(F.col("slug"))
    )
    date = F.when(kind == 4, "2024-02-30").when(kind == 5, "1.2.2024").otherwise(F.col("request_date").cast("string"))
    return V.requests(spark, sf_dir).select("request_id", slug.alias("site_slug"), date.alias("date_text"))


_REQUEST_ISSUES_SQL = f"""SELECT request_id, CASE WHEN k % 6 IN (2, 3) THEN 'siteSlug' ELSE 'date' END AS path,
  CASE k % 6 WHEN 2 THEN '{fixed.WRONG_SLUG}' WHEN 3 THEN '{fixed.REQUIRED}' WHEN 4 THEN '{fixed.DATE_REAL_MESSAGE}'
    ELSE '{fixed.DATE_FORMAT_MESSAGE}' END AS message FROM reqs"""


@query("a20_detail_request_rules", with_views(("reqs",), f"{_REQUEST_ISSUES_SQL} WHERE k % 6 IN (2, 3, 4, 5)"))
def detail_request_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _site_requests(spark, sf_dir).withColumn("issues", rules.site_request_issues(with_date=True))
    return rules.issue_rows(checked, ["request_id"]).drop("issue_pos")


@query("a19_days_request_rules", with_views(("reqs",), f"{_REQUEST_ISSUES_SQL} WHERE k % 6 IN (2, 3)"))
def days_request_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _site_requests(spark, sf_dir).withColumn("issues", rules.site_request_issues(with_date=False))
    return rules.issue_rows(checked, ["request_id"]).drop("issue_pos")


@query(
    "a20_valid_detail_requests",
    with_views(
        ("reqs",),
        "SELECT request_id, slug, strftime(request_date, '%Y-%m-%d') AS forecast_date FROM reqs WHERE k % 6 IN (0, 1)",
    ),
)
def valid_detail_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = rules.valid_site_requests(_site_requests(spark, sf_dir), with_date=True)
    return good.select("request_id", "slug", "forecast_date")


# --- Selection -------------------------------------------------------------------


@query(
    "a44_comparison_sites",
    with_views(("sites_x",), "SELECT id, slug, name FROM sites_x ORDER BY id, slug LIMIT 3 OFFSET 1"),
)
def comparison_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.comparison_sites(V.sites(spark, sf_dir).select("id", "slug", "name"))


@query(
    "a45_canonical_site_set",
    with_views(
        ("sites_x",),
        """SELECT id, slug, (SELECT string_agg(u.slug, ',' ORDER BY u.id, u.slug) FROM (
    SELECT s.id AS id, s.slug AS slug UNION SELECT o.id, o.slug FROM others o WHERE o.id <> s.id) u) AS slugs FROM sites_x s""",
        others="SELECT id, slug FROM sites_x ORDER BY id, slug LIMIT 3 OFFSET 1",
    ),
)
def canonical_site_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    site_rows = V.sites(spark, sf_dir).select("id", "slug")
    sets = catalog_ops.canonical_site_sets(site_rows, site_rows)
    return sets.select("id", "slug", F.array_join("slugs", ",").alias("slugs"))


@query(
    "a46_parameter_classification",
    with_views(
        ("views_x",),
        """SELECT view_id, CASE k % 6 WHEN 2 THEN 'repeated' WHEN 5 THEN 'missing' ELSE 'single' END AS site_kind,
  CASE WHEN k % 6 NOT IN (2, 5) THEN regexp_extract(url, 'site=([^&]*)', 1) END AS site_value,
  CASE k % 6 WHEN 2 THEN 'missing' WHEN 5 THEN 'missing' WHEN 3 THEN 'invalid' ELSE 'valid' END AS date_kind,
  CASE WHEN k % 6 NOT IN (2, 5) THEN regexp_extract(url, 'date=([^&]*)', 1) END AS date_value FROM views_x""",
    ),
)
def parameter_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.classify_parameters(V.page_views(spark, sf_dir)).select(
        "view_id", "site_kind", "site_value", "date_kind", "date_value"
    )


# The selection in the twin: the default site, and the strip around the view date.
_CHOSEN_SQL = """SELECT v.*, coalesce(s.slug, (SELECT slug FROM sites_x ORDER BY id, slug LIMIT 1)) AS chosen_slug,
  CASE WHEN k % 6 IN (0, 1, 4) AND abs(date_diff('day', view_date, DATE '2024-01-15')) <= 2 THEN DATE '2024-01-15' ELSE view_date END AS chosen_date,
  CASE WHEN k % 6 IN (0, 1, 4) THEN DATE '2024-01-15' END AS url_date
FROM views_x v LEFT JOIN sites_x s ON s.slug = CASE WHEN k % 6 NOT IN (2, 5) THEN regexp_extract(url, 'site=([^&]*)', 1) END"""


@query(
    "a47_selection_fallback",
    with_views(
        ("views_x", "sites_x"),
        f"SELECT view_id, chosen_slug AS selected_slug, {day('chosen_date')} AS selected_date, {day('url_date')} AS date_before_strip FROM chosen",
        chosen=_CHOSEN_SQL,
    ),
)
def selection_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = selection.classify_parameters(V.page_views(spark, sf_dir))
    site_rows = V.sites(spark, sf_dir)
    chosen = selection.resolve_selection(classified, site_rows, "view_date")
    return chosen.select(
        "view_id", "selected_slug", "selected_date",
        selection.requested_date().alias("date_before_strip"),
    )


@query(
    "a48_canonical_query",
    with_views(
        ("views_x", "sites_x"),
        f"""SELECT view_id, text AS canonical_query, regexp_extract(url, '\\?(.*)$', 1) <> text AS differs,
  '/?' || text AS dashboard_path, '/forecast?' || text AS detail_path FROM (
SELECT *, 'site=' || chosen_slug || '&date=' || {day('chosen_date')} AS text FROM chosen) t""",
        chosen=_CHOSEN_SQL,
    ),
)
def canonical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = selection.classify_parameters(V.page_views(spark, sf_dir))
    chosen = selection.resolve_selection(classified, V.sites(spark, sf_dir), "view_date")
    return selection.with_canonical_query(chosen).select(
        "view_id", "canonical_query", "differs", "dashboard_path", "detail_path"
    )


@query(
    "a60_date_cards",
    with_views(
        ("preds", "sites_x", "reqs"),
        f"""SELECT request_id, pos, {day('slot_date')} AS forecast_date, slot_date = today AS is_today,
  pos = request_id % 5 AS is_selected, CASE WHEN slot_date = today THEN 'Today' ELSE strftime(slot_date, '%d %b') END AS label,
  CASE WHEN c100_status = 'missing' THEN 'Unavailable' ELSE {integer_text('c100_value')} || '%' END AS value_text,
  CASE WHEN slot_date = today THEN 'Today. ' ELSE '' END || CASE WHEN c100_status = 'missing'
    THEN '100 or more kilometre chance unavailable. ' || c100_reason
    ELSE {number_text('c100_value')} || ' percent chance of 100 or more kilometres. ' || c100_status || ' data. '
      || c100_level || ' confidence. ' || c100_note END AS description
FROM (SELECT *, {R.SQL_DAY} FROM slots) t""",
        slots=R.SQL_SLOTS,
    ),
)
def date_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of every preview; each request has one of its five dates selected."""
    selected = F.date_add("today", (F.col("request_id") % 5 - 2).cast("int"))
    slots = R.preview(spark, sf_dir).withColumn("selected_date", selected)
    return panels.date_cards(slots, "selected_date").select(
        "request_id", "pos", "forecast_date", "is_today", "is_selected", "label", "value_text", "description"
    )

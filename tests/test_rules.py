"""Accept and reject sides of the contract rules."""

import pytest
from pyspark.sql import functions as F

from liftline.operators import rules
from liftline.plans.checks import NAMESPACE


def paths(spark, issues, row="SELECT 1"):
    return [i["path"] for i in spark.sql(row).select(issues.alias("v")).first()["v"]]


@pytest.mark.parametrize(
    "text, slugs, wrong",
    [
        ("sopot, zlatitsa", ["sopot", "zlatitsa"], []),
        ("sopot,sopot", ["sopot", "sopot"], ["siteSlugs"]),
        ("one,two,three,four,five,six,seven,eight", None, ["siteSlugs"]),
        ("one,two,three,four,five,six,seven", None, []),
        ("sopot,", ["sopot", ""], ["siteSlugs.1"]),
        ("\tsopot , nevsha", ["sopot", "nevsha"], []),
        ("Sopot", ["Sopot"], ["siteSlugs.0"]),
        ("", [""], ["siteSlugs.0"]),
        ("a--b", ["a--b"], ["siteSlugs.0"]),
        ("a" * 80, None, []),
        ("a" * 81, None, ["siteSlugs.0"]),
        ("sopot, x,\tsopot", None, ["siteSlugs"]),
        ("so pot", ["so pot"], ["siteSlugs.0"]),
        (None, None, ["siteSlugs"]),
    ],
)
def test_slug_list(spark, text, slugs, wrong):
    raw = spark.createDataFrame([(text,)], "t string")
    row = raw.select(
        rules.parse_slug_list(F.col("t")).alias("s"),
        rules.slug_list_issues(rules.parse_slug_list(F.col("t"))).alias("i"),
        rules.slug_list_valid(F.col("t")).alias("ok"),
    ).first()
    if slugs is not None:
        assert row["s"] == slugs
    assert [i["path"] for i in row["i"]] == wrong
    assert row["ok"] is (wrong == [])


def site(spark, **changes):
    values = {"id": 1, "slug": "sopot", "name": "Sopot", "latitude": 42.6, "longitude": 23.3} | changes
    df = spark.createDataFrame([tuple(values.values())], "id long, slug string, name string, latitude double, longitude double")
    return [i["path"] for i in df.select(rules.site_issues().alias("v")).first()["v"]]


@pytest.mark.parametrize(
    "changes, wrong",
    [
        ({}, []), ({"id": 0}, ["id"]), ({"id": None}, ["id"]), ({"id": 2**53}, ["id"]), ({"id": 2**53 - 1}, []),
        ({"slug": "New Site"}, ["slug"]), ({"slug": "new-site"}, []), ({"name": " \t"}, ["name"]),
        ({"latitude": 90.0}, []), ({"latitude": 90.1}, ["latitude"]), ({"longitude": -180.1}, ["longitude"]),
        ({"latitude": float("nan")}, ["latitude"]), ({"longitude": float("inf")}, ["longitude"]),
        ({"latitude": None, "longitude": -180.0}, ["latitude"]),
    ],
)
def test_site_rules(spark, changes, wrong):
    assert site(spark, **changes) == wrong


METRIC = "struct<value:double,dataStatus:string,confidence:struct<level:string,note:string>,missingReason:string>"


def outputs(spark, *values):
    """Outputs with the given cloudbase and chances; None is a missing metric."""
    def metric(v):
        return (None, "missing", None, "No run.") if v is None else (v, "mock", ("low", "Note."), None)

    row = tuple(metric(v) for v in values)
    schema = ", ".join(f"{n} {METRIC}" for n in ("cloudbaseMslM", "chance100KmPct", "chance200KmPct", "chance300KmPct"))
    df = spark.createDataFrame([row], schema)
    risk = F.struct(F.lit("low").alias("value"), F.lit("mock").alias("dataStatus"), F.struct(F.lit("low").alias("level"), F.lit("n").alias("note")).alias("confidence"), F.lit(None).cast("string").alias("missingReason"))
    return df.select(F.struct("*", risk.alias("overdevelopmentRisk")).alias("o"))


@pytest.mark.parametrize(
    "values, domain, nesting",
    [
        ((2200.0, 60.0, 30.0, 10.0), [], []),
        ((2200.0, 60.0, 60.0, 60.0), [], []),
        ((2200.0, 101.0, 30.0, 10.0), ["o.chance100KmPct.value"], []),
        ((-1.0, 60.0, 30.0, 10.0), ["o.cloudbaseMslM.value"], []),
        ((2200.0, 60.0, 70.0, 10.0), [], ["o.chance100KmPct.value"]),
        ((2200.0, 60.0, 30.0, 40.0), [], ["o.chance200KmPct.value"]),
        ((2200.0, 5.0, None, 10.0), [], ["o.chance100KmPct.value"]),
        ((2200.0, None, 30.0, 10.0), [], []),
        ((2200.0, float("nan"), 30.0, 10.0), ["o.chance100KmPct.value"], []),
        ((float("inf"), 60.0, 30.0, 10.0), ["o.cloudbaseMslM.value"], []),
    ],
)
def test_outputs(spark, values, domain, nesting):
    row = outputs(spark, *values).select(
        rules.output_metric_issues(F.col("o"), "o").alias("d"), rules.nesting_issues(F.col("o"), "o").alias("n")
    ).first()
    assert [i["path"] for i in row["d"]] == domain
    assert [i["path"] for i in row["n"]] == nesting


@pytest.mark.parametrize(
    "metric, valid",
    [
        ((50.0, "mock", ("low", "n"), None), True), ((None, "missing", None, "No run."), True),
        ((0.0, "missing", None, "No run."), False), ((None, "missing", None, None), False),
        ((None, "missing", None, "  "), False), ((50.0, "mock", None, None), False),
        ((50.0, "mock", ("low", " "), None), False), ((50.0, "mock", ("huge", "n"), None), False),
        ((50.0, "mock", ("low", "n"), "why"), False), ((50.0, "other", ("low", "n"), None), False),
        ((None, "mock", ("low", "n"), None), False), ((None, "missing", ("low", "n"), "No run."), False),
        ((None, None, None, None), False),
    ],
)
def test_metric_branches(spark, metric, valid):
    df = spark.createDataFrame([(metric,)], f"m {METRIC}")
    rule = rules.metric_valid(F.col("m"), rules.output_value_rule("chance100KmPct", F.col("m.value")))
    assert df.select(rule.alias("v")).first()["v"] is valid


@pytest.mark.parametrize(
    "levels, valid",
    [
        ([(1500.0, 230.0, 22.0)], True), ([], False), (None, False), ([(1500.0, 230.0, 22.0)] * 7, False),
        ([(1500.0, 361.0, 22.0)], False), ([(-1.0, 0.0, 0.0)], False), ([(1500.0, None, 22.0)], False),
    ],
)
def test_wind_levels(spark, levels, valid):
    df = spark.createDataFrame([(levels,)], "w array<struct<altitudeMslM:double,directionDeg:double,speedKmh:double>>")
    assert df.select(rules.wind_levels_rule(F.col("w")).alias("v")).first()["v"] is valid


@pytest.mark.parametrize(
    "items, wrong",
    [
        ([(1, "a", "d"), (2, "b", "d")], []),
        ([(1, "a", "x"), (2, "b", "d")], ["summaries.0.forecastDate"]),
        ([(2, "b", "d"), (1, "a", "d")], ["summaries.1.siteId"]),
        ([(1, "a", "d"), (2, "a", "d")], ["summaries.1.siteSlug"]),
        ([(1, "a", "d"), (1, "b", "d")], ["summaries.1.siteId", "summaries.1.siteId"]),
        # The order rule compares with the previous row, not with the largest so far.
        ([(5, "a", "d"), (2, "b", "d"), (3, "c", "d")], ["summaries.1.siteId"]),
        ([], ["summaries"]),
        ([(i, f"s{i}", "d") for i in range(1, 9)], ["summaries"]),
    ],
)
def test_ordered_batch(spark, items, wrong):
    df = spark.createDataFrame([(items,)], "s array<struct<siteId:long,siteSlug:string,forecastDate:string>>")
    found = df.select(rules.summary_batch_issues(F.col("s"), F.lit("d")).alias("v")).first()["v"]
    assert [i["path"] for i in found] == wrong


@pytest.mark.parametrize(
    "zone, today, days, wrong",
    [
        ("Europe/Sofia", "2026-01-01", ["2025-12-30", "2025-12-31", "2026-01-01", "2026-01-02", "2026-01-03"], []),
        ("UTC", "2026-01-01", ["2025-12-30", "2025-12-31", "2026-01-01", "2026-01-02", "2026-01-03"], ["timeZone"]),
        ("Europe/Sofia", "2026-07-21", ["2026-07-19", "2026-07-20", "2026-07-21", "2026-07-22"], ["days"]),
        ("Europe/Sofia", "2026-07-21", ["2026-07-18", "2026-07-20", "2026-07-21", "2026-07-22", "2026-07-23"], ["days.0.forecastDate"]),
        ("Europe/Sofia", "2026-02-30", ["a", "b", "c", "d", "e"], ["todayDate"]),
    ],
)
def test_strip(spark, zone, today, days, wrong):
    df = spark.createDataFrame([(zone, today, days)], "z string, t string, d array<string>")
    found = df.select(rules.strip_issues(F.col("z"), F.col("t"), F.col("d")).alias("v")).first()["v"]
    assert [i["path"] for i in found] == wrong


def test_problem_must_agree_with_its_code(spark):
    rows = [("VALIDATION_ERROR", "Invalid request", 400, f"urn:{NAMESPACE}:problem:site-not-found", "Detail."),
            ("FORECAST_NOT_FOUND", "Forecast not found", 404, f"urn:{NAMESPACE}:problem:forecast-not-found", "Detail."),
            ("SITE_NOT_FOUND", "Other", 400, f"urn:{NAMESPACE}:problem:site-not-found", " ")]
    df = spark.createDataFrame(rows, "code string, title string, status int, type string, detail string")
    found = [[i["path"] for i in r["v"]] for r in df.select(rules.problem_issues(NAMESPACE).alias("v")).collect()]
    assert found == [["type"], [], ["title", "status", "detail"]]


def test_issue_rows_use_the_root_sign(spark):
    df = spark.sql("SELECT 1 AS id, array(struct('' AS path, 'm' AS message)) AS issues UNION ALL SELECT 2, array()")
    assert [tuple(r) for r in rules.issue_rows(df, ["id"]).collect()] == [(1, 0, "$", "m")]

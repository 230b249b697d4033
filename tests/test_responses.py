"""Response bodies: each way to fail, and what the sinks write is read back whole."""

import json

import pytest
from pyspark.sql import functions as F

from liftline.sources import responses
from tests.test_json import available, missing

SITE = {"id": 3, "slug": "sopot", "name": "Sopot", "latitude": 42.5, "longitude": 24}
OUTPUTS = {
    "cloudbaseMslM": available(2200), "chance100KmPct": available(60), "chance200KmPct": available(30.5),
    "chance300KmPct": available(10), "overdevelopmentRisk": available("medium"),
}
GIVEN = {
    "availability": "available", "siteId": 3, "siteSlug": "sopot", "forecastDate": "2026-07-18",
    "generatedAt": "2026-07-17T12:00:00.000Z", "provenance": {"source": "s", "version": "v"}, "outputs": OUTPUTS,
}
GONE = {"availability": "missing", "siteId": 5, "siteSlug": "gone", "forecastDate": "2026-07-18", "missingReason": "No run."}
DATES = [f"2026-07-{d}" for d in range(16, 21)]
STRIP = {
    "siteId": 3, "siteSlug": "sopot", "timeZone": "Europe/Sofia", "todayDate": "2026-07-18",
    "days": [{"forecastDate": d, "chance100KmPct": missing() if d.endswith("17") else available(5)} for d in DATES],
}
BATCH = {"forecastDate": "2026-07-18", "summaries": [GIVEN, GONE]}


def without(record, *names):
    return {k: v for k, v in record.items() if k not in names}


def batch(*items, date="2026-07-18"):
    return {"forecastDate": date, "summaries": list(items)}


def strip(**fields):
    return STRIP | fields


def day(i, **fields):
    return strip(days=[d | fields if n == i else d for n, d in enumerate(STRIP["days"])])


SHAPE, WORD = "Expected the declared keys with their JSON types.", "Expected one of the allowed words."
SITES_CASES = [
    ({"sites": []}, None),
    ({"sites": [SITE, SITE | {"slug": " b "}]}, None),
    ({"sites": [SITE], "x": 1}, ""),
    ({"sites": [SITE, SITE | {"x": None}]}, "sites.1"),
    ({"sites": [without(SITE, "name"), SITE]}, "sites.0"),
    ({"sites": [SITE | {"id": "3"}]}, "sites.0"),
    ({"sites": [SITE | {"id": None}]}, "sites.0"),
    ({"sites": [json.dumps(SITE)]}, "sites.0"),
    ({"sites": [SITE, None]}, "sites.1"),
    ({"sites": [SITE, 5]}, "sites.1"),
    ({"sites": {}}, ""),
    ({"sites": None}, ""),
    ({}, ""),
    ([SITE], ""),
    (None, ""),
    ({"sites": [SITE, SITE | {"latitude": 90.5}]}, "sites.1.latitude"),
    ({"sites": [SITE | {"slug": "No"}]}, "sites.0.slug"),
    ({"sites": [SITE | {"name": " "}]}, "sites.0.name"),
    ({"sites": [SITE | {"id": 0}]}, "sites.0.id"),
    ({"sites": [SITE], "a: STRING, sites": 1}, ""),
]
SUMMARY_CASES = [
    (BATCH, None),
    (batch(GONE), None),
    (batch(), "summaries"),
    (batch(*[GONE | {"siteId": i, "siteSlug": f"s{i}"} for i in range(1, 8)]), None),
    (batch(*[GONE | {"siteId": i, "siteSlug": f"s{i}"} for i in range(1, 9)]), "summaries"),
    (BATCH | {"x": 1}, ""),
    (without(BATCH, "forecastDate"), ""),
    (batch(GIVEN, GONE, date="2026-07-19"), "summaries.0.forecastDate"),
    (batch(GIVEN, GONE, date="2026-02-30"), "forecastDate"),
    (batch(GONE, GIVEN), "summaries.1.siteId"),
    (batch(GIVEN, GONE | {"siteId": 3}), "summaries.1.siteId"),
    (batch(GIVEN, GONE | {"siteSlug": "sopot"}), "summaries.1.siteSlug"),
    (batch(GIVEN, GONE | {"siteSlug": " sopot"}), "summaries.1.siteSlug"),
    (batch(GIVEN, GONE | {"outputs": OUTPUTS}), "summaries.1"),
    (batch(GIVEN | {"missingReason": "why"}), "summaries.0"),
    (batch(without(GIVEN, "outputs")), "summaries.0"),
    (batch(GIVEN | {"availability": "missing"}), "summaries.0.missingReason"),
    (batch(GONE | {"availability": "available"}), "summaries.0.generatedAt"),
    (batch(GONE | {"availability": "omitted"}), "summaries.0.availability"),
    (batch(GONE | {"missingReason": " "}), "summaries.0.missingReason"),
    (batch(GIVEN | {"generatedAt": "2026-07-17T12:00:00+02:00"}), "summaries.0.generatedAt"),
    (batch(GIVEN | {"provenance": {"source": "", "version": "v"}}), "summaries.0.provenance.source"),
    (batch(GIVEN | {"outputs": OUTPUTS | {"chance100KmPct": available(101)}}), "summaries.0.outputs.chance100KmPct.value"),
    (batch(GIVEN | {"outputs": OUTPUTS | {"chance200KmPct": available(61)}}), "summaries.0.outputs.chance100KmPct.value"),
    (batch(GIVEN | {"outputs": OUTPUTS | {"chance100KmPct": missing()}}), None),
    (batch(GIVEN | {"outputs": OUTPUTS | {"chance100KmPct": available("60")}}), "summaries.0"),
    (batch(GIVEN | {"outputs": without(OUTPUTS, "chance100KmPct")}), "summaries.0"),
]
DAY_CASES = [
    (STRIP, None),
    (strip(timeZone="UTC"), "timeZone"),
    (strip(todayDate="2026-07-19"), "days.0.forecastDate"),
    (strip(todayDate="19 July"), "todayDate"),
    (strip(days=STRIP["days"][:4]), "days"),
    (strip(days=[]), "days"),
    (strip(days=None), ""),
    (strip(siteId=0), "siteId"),
    (strip(siteId=2.5), ""),
    (strip(siteSlug="A"), "siteSlug"),
    (day(2, forecastDate="2026-07-17"), "days.2.forecastDate"),
    (day(2, forecastDate=5), "days.2"),
    (day(2, extra=5), "days.2"),
    (day(3, chance100KmPct=available(-1)), "days.3.chance100KmPct.value"),
    (day(3, chance100KmPct=missing() | {"dataStatus": "mock"}), "days.3.chance100KmPct.value"),
    (day(3, chance100KmPct=available(5) | {"dataStatus": "odd"}), "days.3.chance100KmPct.dataStatus"),
    (day(3, chance100KmPct=None), "days.3"),
]
PARSERS = [
    (responses.parse_sites_responses, SITES_CASES),
    (responses.parse_summaries_responses, SUMMARY_CASES),
    (responses.parse_days_responses, DAY_CASES),
]


@pytest.mark.parametrize("parse, cases", PARSERS)
def test_first_issue_of_each_body(spark, parse, cases):
    raw = spark.createDataFrame([(n, json.dumps(body)) for n, (body, _path) in enumerate(cases)], "n int, raw string")
    found = {r["n"]: r for r in parse(raw, "raw").collect()}
    for n, (body, path) in enumerate(cases):
        row = found[n]
        first = row["issues"][0]["path"] if row["issues"] else None
        assert (first, row["failure_reason"]) == (path, None if path is None else "schema-validation"), body
        assert (row["record"] is None) == (path is not None)


@pytest.mark.parametrize("parse, cases", PARSERS)
def test_no_json_and_no_rows(spark, parse, cases):
    texts = [None, "", "{", json.dumps(cases[0][0])[:-1], '{"sites": [], "sites": []}']
    raw = spark.createDataFrame([(t,) for t in texts], "raw string")
    rows = parse(raw, "raw").collect()
    assert [r["failure_reason"] for r in rows] == ["malformed-json"] * 5
    assert all(r["issues"] == [] and r["record"] is None for r in rows)
    assert parse(raw.limit(0), "raw").collect() == []


PROBLEM = {
    "type": "urn:ns:problem:site-not-found", "title": "Site not found", "status": 404, "detail": "No site.",
    "code": "SITE_NOT_FOUND", "requestId": "r-1", "issues": [{"path": "", "message": "m"}],
}
PROBLEM_CASES = [
    (PROBLEM, None),
    (PROBLEM | {"issues": []}, None),
    (without(PROBLEM, "issues"), None),
    (PROBLEM | {"issues": None}, ""),
    (PROBLEM | {"issues": [{"path": "", "message": "m", "x": 1}]}, ""),
    (PROBLEM | {"issues": [{"path": "", "message": "m"}, {"message": "m"}]}, "issues.1.path"),
    (PROBLEM | {"issues": [{"path": "", "message": "m"}, None]}, "issues.1.path"),
    (PROBLEM | {"issues": [{"path": "", "message": " "}]}, "issues.0.message"),
    (PROBLEM | {"status": 400}, "status"),
    (PROBLEM | {"status": "404"}, ""),
    (PROBLEM | {"type": "urn:other:problem:site-not-found"}, "type"),
    (PROBLEM | {"code": "OTHER"}, "code"),
    (PROBLEM | {"requestId": "a b"}, "requestId"),
    (PROBLEM | {"detail": ""}, "detail"),
    (without(PROBLEM, "detail"), ""),
    (5, ""),
]


def test_problems_and_their_text(spark):
    texts = [json.dumps(body) for body, _path in PROBLEM_CASES]
    raw = spark.createDataFrame(list(enumerate([*texts, "{", None])), "n int, raw string")
    parsed = responses.parse_problems(raw, "raw", "ns")
    out = F.when(F.col("record").isNotNull(), responses.problem_json(F.col("record")))
    found = {r["n"]: r for r in parsed.withColumn("out", out).collect()}
    for n, (body, path) in enumerate(PROBLEM_CASES):
        row = found.pop(n)
        assert (row["issues"][0]["path"] if row["issues"] else None) == path, body
        assert (json.loads(row["out"]) if row["out"] else None) == (body if path is None else None)
    assert {r["failure_reason"] for r in found.values()} == {"malformed-json"}


def test_columns_beside_the_text_stay(spark):
    raw = spark.createDataFrame([(json.dumps(BATCH), 1, 2)], "raw string, siteId int, summaries int")
    row = responses.parse_summaries_responses(raw, "raw").collect()[0]
    assert (row["siteId"], row["summaries"], len(row["record"]["summaries"])) == (1, 2, 2)


def test_written_bodies_are_read_back(spark):
    raw = spark.createDataFrame([(json.dumps(BATCH), json.dumps(STRIP), json.dumps({"sites": [SITE]}))], "a string, b string, c string")
    batches = responses.parse_summaries_responses(raw.select("a"), "a")
    summaries = batches.select(
        F.lit(1).alias("request_id"), F.to_date("record.forecastDate").alias("forecast_date"),
        F.posexplode("record.summaries").alias("pos", "summary"),
    )
    written = responses.summaries_responses(summaries.orderBy(F.desc("pos"))).collect()[0]["body"]
    assert json.loads(written) == BATCH
    strips = responses.parse_days_responses(raw.select("b"), "b").select("record.*")
    preview = strips.select(
        F.lit(1).alias("request_id"), F.col("siteId").alias("site_id"), F.col("siteSlug").alias("slug"),
        F.to_date("todayDate").alias("today"), F.posexplode("days").alias("pos", "day"),
    ).select("*", F.to_date("day.forecastDate").alias("forecast_date"), "day.chance100KmPct")
    assert json.loads(responses.days_responses(preview).collect()[0]["body"]) == STRIP
    sites = responses.parse_sites_responses(raw.select("c"), "c")
    assert json.loads(sites.select(responses.sites_response_json(F.col("record.sites"))).collect()[0][0]) == {"sites": [SITE]}

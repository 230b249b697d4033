"""Strict JSON documents: round trip and every way to fail."""

import json

import pytest
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline.sources import json_records


def available(value):
    return {"value": value, "dataStatus": "mock", "confidence": {"level": "low", "note": "Test value."}}


def given(value):
    return {"value": value, "dataStatus": "mock"}


def document():
    inputs = {
        name: given(1000 if name == "surfacePressureHpa" else 10.5)
        for name, _label, _unit, kind in fixed.INPUT_PANEL
        if kind in ("number", "integer")
    }
    return {
        "siteId": 3, "siteSlug": "sopot", "forecastDate": "2026-07-18", "generatedAt": "2026-07-17T12:00:00.000Z",
        "provenance": {"source": "test-source", "version": "v1"},
        "outputs": {
            "cloudbaseMslM": available(2200), "chance100KmPct": available(60), "chance200KmPct": available(30),
            "chance300KmPct": available(10), "overdevelopmentRisk": available("medium"),
        },
        "forecastInputs": {
            "provenance": {"source": "weather", "version": "w1"}, "sourceRunAt": "2026-07-17T12:00:00.000Z", **inputs,
            "windByAltitude": given([{"altitudeMslM": 1500, "directionDeg": 230, "speedKmh": 22}]),
            "convergenceSignal": given("weak"),
        },
        "topDrivers": ["Test driver"],
    }


def missing(confidence=True):
    gone = {"value": None, "dataStatus": "missing", "missingReason": "No run."}
    return gone | {"confidence": None} if confidence else gone


def changed(path, value):
    doc = document()
    spot = doc
    for part in path[:-1]:
        spot = spot[part]
    if value is KeyError:
        del spot[path[-1]]
    else:
        spot[path[-1]] = value
    return json.dumps(doc)


GOOD = [
    json.dumps(document()),
    changed(["outputs", "cloudbaseMslM"], missing()),
    changed(["forecastInputs", "capeJPerKg"], missing(False)),
    changed(["generatedAt"], "2026-07-17T12:00Z"),
]
BAD = [
    changed(["extra"], 1),
    changed(["outputs", "extra"], None),
    changed(["outputs", "chance100KmPct", "missingReason"], "why"),
    changed(["outputs", "chance100KmPct", "missingReason"], None),
    changed(["outputs", "cloudbaseMslM"], missing() | {"value": 0}),
    changed(["outputs", "cloudbaseMslM"], {"dataStatus": "missing", "confidence": None, "missingReason": "No run."}),
    changed(["outputs", "chance100KmPct", "confidence", "extra"], 1),
    changed(["outputs", "chance100KmPct", "value"], "60"),
    changed(["outputs", "chance100KmPct", "value"], 101),
    changed(["outputs", "chance200KmPct", "value"], 61),
    changed(["siteId"], "3"),
    changed(["siteId"], 3.5),
    changed(["siteSlug"], 5),
    changed(["siteSlug"], KeyError),
    changed(["provenance", "source"], 5),
    changed(["provenance", "extra"], 5),
    changed(["forecastDate"], "2026-02-30"),
    changed(["topDrivers"], []),
    changed(["topDrivers"], ["a", 1]),
    changed(["topDrivers"], ["a", " "]),
    changed(["forecastInputs", "windByAltitude", "value"], []),
    changed(
        ["forecastInputs", "windByAltitude", "value"],
        [{"altitudeMslM": 1, "directionDeg": 2, "speedKmh": 3, "extra": 4}],
    ),
    changed(["forecastInputs", "capeJPerKg", "confidence"], None),
    changed(["forecastInputs", "sourceRunAt"], "yesterday"),
    "[1, 2]",
    "null",
    "5",
]
MALFORMED = ["", "{", json.dumps(document())[:-1], "{'siteId': 3}"]


def parsed(spark, texts):
    raw = spark.createDataFrame(list(enumerate(texts)), "n int, raw string")
    return json_records.parse_forecast_documents(raw, "raw")


@pytest.mark.parametrize("texts, reason", [(GOOD, None), (BAD, "schema-validation"), (MALFORMED, "malformed-json")])
def test_documents(spark, texts, reason):
    rows = parsed(spark, texts).select("n", "failure_reason", "raw").collect()
    assert [(r["raw"], r["failure_reason"]) for r in rows if r["failure_reason"] != reason] == []


def test_round_trip_keeps_each_document(spark):
    good, bad = json_records.split_documents(parsed(spark, GOOD + BAD), "raw")
    record = F.struct(*[F.col(n) for n in json_records.schemas.FORECAST_DOCUMENT.names])
    rows = good.select("raw", json_records.document_json(record).alias("out")).collect()
    assert len(rows) == len(GOOD) and bad.count() == len(BAD)
    for row in rows:
        assert json.loads(row["out"]) == json.loads(row["raw"])


def test_sink_writes_nulls_and_no_stray_reason(spark, tmp_path):
    good, _bad = json_records.split_documents(parsed(spark, GOOD[:2]), "raw")
    record = F.struct(*[F.col(n) for n in json_records.schemas.FORECAST_DOCUMENT.names])
    json_records.write_json_lines(good.select(json_records.document_json(record).alias("j")), "j", str(tmp_path / "out"))
    documents = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    metrics = [d["outputs"]["cloudbaseMslM"] for d in documents]
    assert sorted(sorted(m) for m in metrics) == [
        ["confidence", "dataStatus", "missingReason", "value"], ["confidence", "dataStatus", "value"],
    ]

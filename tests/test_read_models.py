"""Golden results of the read models on the seed catalog, with rows in random order."""

import pytest
from pyspark.sql import functions as F

from liftline.operators import catalog, correlation, lookups, panels, readmodels
from tests import golden


@pytest.fixture(scope="module")
def sites(spark):
    return golden.sites(spark).orderBy(F.rand(5)).cache()


@pytest.fixture(scope="module")
def predictions(spark):
    return golden.predictions(spark).cache()


def requests(spark, *rows):
    return spark.createDataFrame(rows, "request_id long, date string, slugs array<string>").select(
        "request_id", F.col("date").cast("date").alias("forecast_date"), "slugs"
    )


def test_five_day_preview(spark, sites, predictions):
    asked = spark.createDataFrame([(1, "sopot"), (2, "unknown-site")], "request_id long, slug string").withColumn(
        "today", F.lit(golden.TODAY).cast("date")
    )
    rows = readmodels.day_preview(asked, sites, predictions).orderBy("request_id", "pos").collect()
    assert [r["chance100KmPct"]["value"] for r in rows] == [55, 60, 65, 73, 62]
    assert [str(r["forecast_date"]) for r in rows] == [f"2026-07-{n}" for n in range(15, 20)]
    assert {r["site_id"] for r in rows} == {3}


def test_preview_keeps_gaps_in_place(spark, sites, predictions):
    asked = spark.createDataFrame([(1, "sopot")], "request_id long, slug string").withColumn(
        "today", F.lit(golden.TODAY).cast("date")
    )
    only_today = predictions.where("forecast_date = '2026-07-17'")
    rows = readmodels.day_preview(asked, sites, only_today).orderBy("pos").collect()
    assert len(rows) == 5
    first, third = rows[0]["chance100KmPct"], rows[2]["chance100KmPct"]
    assert (first["value"], first["dataStatus"], first["confidence"]) == (None, "missing", None)
    assert first["missingReason"] == "No 100+ km forecast is available for site 'sopot' on 2026-07-15."
    assert (third["value"], third["dataStatus"]) == (65, "mock")


def test_summaries_are_ordered_by_site_and_keep_missing_items(spark, sites, predictions):
    asked = requests(spark, (1, "2026-07-18", ["sopot", "sofia-vitosha-kominite"]))
    some = predictions.where("site_id = 3")
    rows = readmodels.batched_summaries(asked, sites, some).orderBy("pos").collect()
    assert [r["summary"]["siteSlug"] for r in rows] == ["sofia-vitosha-kominite", "sopot"]
    assert [r["summary"]["availability"] for r in rows] == ["missing", "available"]
    assert (
        rows[0]["summary"]["missingReason"]
        == "No forecast exists for site 'sofia-vitosha-kominite' on 2026-07-18."
    )
    assert rows[0]["summary"]["outputs"] is None


def test_one_unknown_slug_fails_the_whole_request(spark, sites, predictions):
    asked = requests(spark, (1, "2026-07-18", ["sopot", "unknown-site"]), (2, "2026-07-18", ["sopot"]))
    rows = readmodels.batched_summaries(asked, sites, predictions).collect()
    assert [r["request_id"] for r in rows] == [2]
    failed = readmodels.unknown_requests(readmodels.resolve_sites(asked, sites)).collect()
    assert [(r["request_id"], r["detail"]) for r in failed] == [
        (1, "No forecast site exists for slug 'unknown-site'.")
    ]


def test_detailed_lookup_outcomes(spark, sites, predictions):
    asked = spark.createDataFrame(
        [(1, "sopot", "2026-07-18"), (2, "sopot", "2026-07-20"), (3, "unknown-site", "2026-07-18")],
        "request_id long, slug string, date string",
    ).select("request_id", "slug", F.col("date").cast("date").alias("forecast_date"))
    rows = {r["request_id"]: r for r in readmodels.detailed_lookup(asked, sites, predictions).collect()}
    assert [rows[i]["outcome"] for i in (1, 2, 3)] == ["found", "FORECAST_NOT_FOUND", "SITE_NOT_FOUND"]
    outputs = rows[1]["record"]["outputs"]
    assert [outputs[n]["value"] for n in ("cloudbaseMslM", "chance100KmPct", "chance200KmPct", "chance300KmPct")] == [2500, 73, 39, 13]
    assert outputs["overdevelopmentRisk"]["value"] == "medium"
    assert rows[2]["detail"] == "No forecast exists for site 'sopot' on 2026-07-20."
    assert rows[3]["detail"] == "No forecast site exists for slug 'unknown-site'."


def test_multi_site_read_keeps_request_order(spark, predictions):
    asked = spark.createDataFrame([(1, "2026-07-18", [3, 99, 1, 3])], "request_id long, d string, site_ids array<long>").select(
        "request_id", F.col("d").cast("date").alias("forecast_date"), "site_ids"
    )
    rows = lookups.read_site_lists(asked, predictions, "request_id").orderBy("pos").collect()
    assert [(r["pos"], r["site_id"]) for r in rows] == [(0, 3), (2, 1), (3, 3)]


def test_date_range_is_inclusive(spark, predictions):
    asked = spark.createDataFrame([(1, 3, "2026-07-16", "2026-07-18"), (2, 3, "2026-07-18", "2026-07-16")], "request_id long, site_id long, a string, b string").select(
        "request_id", "site_id", F.col("a").cast("date").alias("from_date"), F.col("b").cast("date").alias("through_date")
    )
    rows = lookups.read_date_ranges(asked, predictions).orderBy("forecast_date").collect()
    assert [(r["request_id"], r["p100"]) for r in rows] == [(1, 60), (1, 65), (1, 73)]


def test_cards_tell_missing_from_omitted(spark, sites, predictions):
    asked = requests(spark, (1, "2026-07-20", ["sopot"]), (2, "2026-07-18", ["sopot"]))
    summaries = readmodels.batched_summaries(asked, sites, predictions)
    cards = spark.createDataFrame([(1, "sopot"), (1, "nevsha"), (2, "sopot")], "request_id long, slug string")
    rows = readmodels.three_state_cards(cards, summaries).orderBy("request_id", "slug").collect()
    assert [r["state"] for r in rows] == ["omitted", "missing", "available"]


def test_chances_stay_nested_for_every_site(predictions):
    assert predictions.where("p100 < p200 OR p200 < p300").count() == 0 and predictions.count() == 35


def test_default_site_and_comparison(spark, sites):
    assert catalog.default_site(sites).first()["slug"] == "sofia-vitosha-kominite"
    assert catalog.default_site(sites.where("id < 0")).count() == 0
    assert [r["slug"] for r in catalog.comparison_sites(sites).collect()] == ["zlatitsa", "sopot", "nevsha"]
    box = catalog.bounding_box(sites).first()
    assert (box["south"], box["west"], box["north"], box["east"]) == (42.60222, 23.28927, 43.56667, 27.83333)


@pytest.mark.parametrize(
    "keep, expected",
    [
        (None, ["zlatitsa", "sopot", "nevsha"]),
        (["sopot", "dobrich-region", "zlatitsa"], ["sopot", "dobrich-region"]),
    ],
)
def test_canonical_site_set(spark, sites, keep, expected):
    part = sites if keep is None else sites.where(F.col("slug").isin(keep))
    chosen = part.where("slug = 'sopot'").select("id", "slug")
    assert catalog.canonical_site_sets(chosen, part).first()["slugs"] == expected


def test_canonical_set_drops_a_repeated_id(spark, sites):
    doubled = sites.where("slug IN ('sopot', 'zlatitsa')").unionByName(
        sites.where("slug = 'dobrich-region'").withColumn("id", F.lit(2).cast("long"))
    )
    chosen = sites.where("slug = 'sopot'").select("id", "slug")
    assert catalog.canonical_site_sets(chosen, doubled).first()["slugs"] == ["zlatitsa", "sopot"]


def test_duplicate_keys(spark):
    rows = [(0, 1, "a"), (1, 1, "b"), (2, 2, "a"), (3, 1, "a")]
    found = catalog.duplicate_rows(spark.createDataFrame(rows, "pos long, id long, slug string"))
    assert sorted((r["pos"], r["message"]) for r in found.collect()) == [
        (1, "Duplicate site ID: 1"), (2, "Duplicate site slug: a"), (3, "Duplicate site ID: 1"),
    ]


def test_correlation(spark):
    asked = spark.createDataFrame([(1, "2026-07-18", ["zlatitsa", "sopot"]), (2, "2026-07-18", ["sopot"]), (3, "2026-07-18", ["sopot"])], "request_id long, date string, slugs array<string>")
    got = spark.createDataFrame([(1, "2026-07-18", ["sopot"]), (2, "2026-07-19", ["nevsha"]), (3, "2026-07-18", ["sopot", "nevsha"])], "request_id long, date string, slugs array<string>")
    rows = {r["request_id"]: r["message"] for r in correlation.summaries_violations(asked, got).collect()}
    assert rows == {
        2: "The forecast service returned summaries for a different date.",
        3: "The forecast service returned a summary for an unrequested location.",
    }


def metric(value, status="mock", level="low", note="Note."):
    if status == "missing":
        return (None, "missing", None, "No run.")
    return (value, status, (level, note), None)


OUTPUTS = (
    "cloudbaseMslM struct<value:double,dataStatus:string,confidence:struct<level:string,note:string>,missingReason:string>,"
    "chance100KmPct struct<value:double,dataStatus:string,confidence:struct<level:string,note:string>,missingReason:string>,"
    "chance200KmPct struct<value:double,dataStatus:string,confidence:struct<level:string,note:string>,missingReason:string>,"
    "chance300KmPct struct<value:double,dataStatus:string,confidence:struct<level:string,note:string>,missingReason:string>,"
    "overdevelopmentRisk struct<value:string,dataStatus:string,confidence:struct<level:string,note:string>,missingReason:string>"
)


def test_rollups(spark):
    plain = [metric(2400.0), metric(65.0), metric(35.0), metric(12.0), metric("medium")]
    mixed = [plain[0], metric(65.0, "manual", "high", "Reviewed."), plain[2], metric(0, "missing"), plain[4]]
    gone = [metric(0, "missing")] * 5
    df = spark.createDataFrame([tuple(plain), tuple(mixed), tuple(gone)], OUTPUTS).select(F.struct("*").alias("o"))
    rows = df.select(panels.output_status(F.col("o")).alias("s"), panels.output_confidence(F.col("o")).alias("c")).collect()
    assert [(r["s"], r["c"]["level"], r["c"]["notes"]) for r in rows] == [
        ("mock", "low", ["Note."]), ("mixed", "mixed", ["Reviewed.", "Note."]), ("missing", "unavailable", []),
    ]
    panel = panels.output_panel(df.select(F.col("o").alias("outputs")).limit(3), []).collect()
    assert [r["value_text"] for r in panel[:5]] == ["2,400 m MSL", "65%", "35%", "12%", "Medium"]
    assert {r["value_text"] for r in panel[10:]} == {"Unavailable"}

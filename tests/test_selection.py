"""Selection from URLs on the seed catalog."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from liftline.operators import selection
from tests import golden

CASES = [
    ("site=sopot&date=2026-07-18", "single", "valid", "sopot", "2026-07-18"),
    ("", "missing", "missing", "sofia-vitosha-kominite", "2026-07-17"),
    ("site=sopot&site=zlatitsa&date=2026-07-18&date=2026-07-19", "repeated", "repeated", "sofia-vitosha-kominite", "2026-07-17"),
    ("site=sopot&date=2026-02-30", "single", "invalid", "sopot", "2026-07-17"),
    ("site=unknown", "single", "missing", "sofia-vitosha-kominite", "2026-07-17"),
    ("date=2026-07-19&site=sopot&unowned=value", "single", "valid", "sopot", "2026-07-19"),
    ("date=2026-08-01", "missing", "valid", "sofia-vitosha-kominite", "2026-07-17"),
    ("site=s%6Fpot#site=nevsha", "single", "missing", "sopot", "2026-07-17"),
    ("site=%zz", "single", "missing", "sofia-vitosha-kominite", "2026-07-17"),
    ("site&date=", "single", "invalid", "sofia-vitosha-kominite", "2026-07-17"),
]


@pytest.fixture(scope="module")
def views(spark):
    rows = [(i, f"http://host/?{query}" if query else "http://host/") for i, (query, *_rest) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "view_id int, url string")
    return selection.classify_parameters(df.withColumn("today", F.lit("2026-07-17").cast("date")))


def test_kinds_and_selection(spark, views):
    chosen = selection.resolve_selection(views, golden.sites(spark), "today").orderBy("view_id").collect()
    got = [(r["site_kind"], r["date_kind"], r["selected_slug"], str(r["selected_date"])) for r in chosen]
    assert got == [tuple(case[1:]) for case in CASES]


def test_without_strip_only_a_valid_date_is_selected(spark, views):
    chosen = selection.resolve_selection(views, golden.sites(spark), None).orderBy("view_id").collect()
    assert [r["selected_date"] for r in chosen[:4]] == [dt.date(2026, 7, 18), None, None, None]


def test_canonical_text(spark, views):
    chosen = selection.resolve_selection(views, golden.sites(spark), None)
    rows = selection.with_canonical_query(chosen).orderBy("view_id").collect()
    assert (rows[0]["canonical_query"], rows[0]["differs"]) == ("site=sopot&date=2026-07-18", False)
    assert (rows[1]["canonical_query"], rows[1]["differs"]) == ("site=sofia-vitosha-kominite", True)
    assert (rows[5]["canonical_query"], rows[5]["differs"]) == ("site=sopot&date=2026-07-19", True)
    assert rows[0]["detail_path"] == "/forecast?site=sopot&date=2026-07-18"

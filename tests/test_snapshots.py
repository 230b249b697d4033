"""Versioned tables: keyed inserts, pruning, interrupted and competing writes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftline.sources.snapshots import Snapshots, VersionTaken

SCHEMA = T.StructType(
    [
        T.StructField("site", T.LongType()),
        T.StructField("day", T.DateType()),
        T.StructField("at", T.LongType()),
        T.StructField("note", T.StringType()),
    ]
)
KEYS = ["site", "day"]


def newest():
    return [F.col("at").desc_nulls_last()]


def table(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "table"), SCHEMA, "day")


def frame(spark, rows):
    return spark.createDataFrame([(s, dt.date(2024, 1, d), at, note) for s, d, at, note in rows], SCHEMA).repartition(3)


def rows_of(df):
    return sorted((r.site, r.day.day, r.at, r.note) for r in df.collect())


def test_one_key_of_a_date_leaves_the_others(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().collect() == [] and t.versions() == []
    assert t.merge(frame(spark, [(s, 1, 5, "a") for s in range(15)] + [(1, 2, 5, "a")]), KEYS, newest()) == 1
    assert t.merge(frame(spark, [(3, 1, 6, "b")]), KEYS, newest()) == 2
    assert rows_of(t.read()) == sorted([(s, 1, 6 if s == 3 else 5, "b" if s == 3 else "a") for s in range(15)] + [(1, 2, 5, "a")])
    assert len(rows_of(t.read(1))) == 16 and (3, 1, 5, "a") in rows_of(t.read(1))
    with pytest.raises(ValueError, match="no version 3"):
        t.read(3)


def test_inserts_equal_a_plain_map(spark, tmp_path):
    random.seed(3)
    t, held = table(spark, tmp_path), {}
    for batch in range(4):
        rows = [(random.randrange(6), random.randint(1, 4), random.choice([None, 1, 2, 3]), f"{batch}-{i}") for i in range(30)]
        # The same key at the same time twice in a batch has no fixed winner; keep one.
        rows = list({r[:3]: r for r in rows}.values())
        t.merge(frame(spark, rows), KEYS, newest())
        for site, day, at, note in sorted(rows, key=lambda r: -1 if r[2] is None else r[2]):
            old = held.get((site, day))
            if old is None or (-1 if at is None else at) >= (-1 if old[0] is None else old[0]):
                held[site, day] = (at, note)
        got = {(r.site, r.day.day): (r.at, r.note) for r in t.read().collect()}
        assert got == held
    assert t.versions() == [1, 2, 3, 4]


def test_batch_run_again_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    batch = frame(spark, [(1, 1, 5, "a"), (1, 1, 5, "a"), (1, 1, 5, "other"), (2, 1, 4, None), (2, 2, None, "x")])
    assert t.merge(batch, KEYS, newest()) == 1
    first = rows_of(t.read())
    assert t.merge(batch, KEYS, newest()) == 1 and t.merge(frame(spark, [(2, 1, 3, "older")]), KEYS, newest()) == 1
    assert t.versions() == [1] and rows_of(t.read()) == first and len(first) == 3


def test_only_changed_dates_are_read_and_written(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(frame(spark, [(s, d, 1, "a") for s in range(5) for d in range(1, 9)]), KEYS, newest())
    before = dict((v, c) for c, v in t._entries(None))
    t.merge(frame(spark, [(9, 2, 1, "new"), (1, 3, 0, "too old")]), KEYS, newest())
    after = dict((v, c) for c, v in t._entries(None))
    assert [v for v in after if after[v] != before[v]] == ["2024-01-02"]
    plan = t.read().where("day = DATE'2024-01-02' AND site = 9")._jdf.queryExecution().executedPlan()
    scan = next(line for line in plan.toString().split("\n") if "FileScan" in line)
    assert "commit_id" in scan.split("PartitionFilters:")[1] and "EqualTo(site,9)" in scan
    files = t.read().where("day = DATE'2024-01-02'").select("site").inputFiles()
    one = t.read().where("day = DATE'2024-01-02'")
    assert one.count() == 6 and len(files) >= 1
    metrics = one.select("site", F.input_file_name().alias("f")).distinct().collect()
    assert all(f"commit_id={after['2024-01-02']}/day=2024-01-02" in r.f for r in metrics)


def test_interrupted_write_stays_invisible(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.replace(frame(spark, [(1, 1, 1, "a"), (1, 2, 1, "a")]))

    def broken(*_):
        raise OSError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_publish", broken)
        for write in (lambda: t.replace(frame(spark, [(1, 1, 2, "b")])), lambda: t.merge(frame(spark, [(1, 1, 2, "b")]), KEYS, newest())):
            with pytest.raises(OSError):
                write()
    assert t.versions() == [1] and rows_of(t.read()) == [(1, 1, 1, "a"), (1, 2, 1, "a")]
    assert t.merge(frame(spark, [(1, 1, 2, "b")]), KEYS, newest()) == 2
    assert rows_of(t.read()) == [(1, 1, 2, "b"), (1, 2, 1, "a")]


def test_competing_writes_do_not_overwrite(spark, tmp_path):
    t = table(spark, tmp_path)
    t.replace(frame(spark, [(1, 1, 1, "a")]))
    commit = t._write(frame(spark, [(1, 1, 1, "late")]))
    with pytest.raises(VersionTaken):
        t._publish(1, [(commit, "2024-01-01")], "")
    assert rows_of(t.read()) == [(1, 1, 1, "a")]


def test_replace_keeps_null_partitions_and_refuses_other_columns(spark, tmp_path):
    t = table(spark, tmp_path)
    odd = spark.createDataFrame([(1, None, 1, "none"), (2, dt.date(2024, 1, 1), 1, "a")], SCHEMA)
    t.replace(odd)
    assert t.read().where("day is null").count() == 1
    t.replace(odd.where("day is null").withColumn("note", F.lit("again")))
    assert sorted(r.note for r in t.read().collect()) == ["a", "again"]
    with pytest.raises(ValueError, match="absent"):
        t.replace(odd.drop("note"))
    with pytest.raises(ValueError, match="cannot be inserted"):
        t.merge(odd, KEYS, newest())

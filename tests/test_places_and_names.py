"""Density clusters, misspelt names and the bucketed table against brute force."""

import random

import pytest

from liftline.operators import clusters, lookups, names
from liftline.sources import tables


def plain_clusters(places, degrees, least):
    """Cell, cluster and whether it is a core, by flooding."""
    around, rows = round(360 / degrees), round(180 / degrees)
    count = {}
    for lat, lon in places:
        if lat is not None and lon is not None:
            cell = (int((lat + 90) // degrees), int((lon + 180) // degrees) % around)
            count[cell] = count.get(cell, 0) + 1
    beside = lambda c: {(c[0] + i, (c[1] + j) % around) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= c[0] + i <= rows} - {c}
    number = lambda c: c[0] * around + c[1]
    cores, label = {c for c, n in count.items() if n >= least}, {}
    for start in sorted(cores, key=number):
        todo = [start] if start not in label else []
        while todo:
            c = todo.pop()
            if c not in label:
                label[c] = number(start)
                todo += [x for x in beside(c) if x in cores]
    out = {number(c): (label[c], count[c], True) for c in cores}
    for c in set(count) - cores:
        near = [label[x] for x in beside(c) if x in cores]
        if near:
            out[number(c)] = (min(near), count[c], False)
    return out


@pytest.mark.parametrize("degrees, least", [(1.0, 3), (0.5, 2), (5.0, 6)])
def test_clusters_equal_flooding(spark, degrees, least):
    random.seed(int(degrees * 10))
    places = [(random.uniform(40, 50), random.uniform(20, 40)) for _ in range(400)]
    places += [(10 + random.uniform(-3, 3), ((180 + random.uniform(-4, 4) + 180) % 360) - 180) for _ in range(500)]
    places += [(90 - random.uniform(0, 2), random.uniform(-180, 180)) for _ in range(60)] + [(-90.0, 180.0), (90.0, -180.0)] * 4
    places += [(42.0 + i * degrees, 60.0) for i in range(7) for _ in range(least)]  # a chain over cells
    places += [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(places, "lat double, lon double").repartition(3)
    got = {r.cell: (r.cluster_id, r.n_places, r.core) for r in clusters.dense_cells(df, "lat", "lon", degrees, least).collect()}
    want = plain_clusters(places, degrees, least)
    assert got == want and len({v[0] for v in want.values()}) > 2
    columns, across = {}, round(360 / degrees) - 1
    for cell, (label, _n, _core) in want.items():
        columns.setdefault(label, set()).add(cell % (across + 1))
    assert any({0, across} <= c for c in columns.values())
    named = clusters.with_cluster(df, clusters.dense_cells(df, "lat", "lon", degrees, least), "lat", "lon", degrees, "c")
    assert named.count() == len(places) and named.where("lon is null or lat is null").where("c is not null").isEmpty()
    assert clusters.dense_cells(df.limit(0), "lat", "lon", degrees, least).collect() == []


def test_cluster_goes_before_region(spark):
    flown = [(i, 42.01, 23.01) for i in range(6)] + [(10 + i, 42.3, 23.0 + 0.06 * i) for i in range(8)] + [(30, 42.31, 23.02), (40, 0.0, 0.0), (41, None, None)]
    launches = [(7, 42.02, 23.02), (5, 42.03, 23.03), (3, 42.45, 23.45)]
    got = clusters.assign_areas(
        spark.createDataFrame(flown, "flight_id long, start_latitude double, start_longitude double"),
        spark.createDataFrame(launches, "launch_id long, latitude double, longitude double"), (0.05, 5), (0.5, 10),
    )
    rows = {r.flight_id: (r.launch_id, r.area) for r in got.collect()}
    assert rows[0] == (5, "cluster") and rows[30] == (3, "region") and rows[40] == rows[41] == (None, "none") and len(rows) == len(flown)


def errors(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_equal_all_pairs(spark):
    random.seed(11)
    letters = "abcé "
    aliases = [("".join(random.choice(letters) for _ in range(random.randint(1, 10))).strip() or "a", i) for i in range(60)]
    aliases += [("Sopot", 100), ("sopot", 99), ("Вършец", 101), (None, 102), ("", 103)]
    written = [None, "", " ", "SOPOT ", "sopt", "sxpxt", "вършц", "Въшрец", "x" * 300]
    for _ in range(250):
        word = list(random.choice(aliases)[0] or "z")
        for _ in range(random.randint(0, 3)):
            place = random.randrange(len(word) + 1)
            word[place : place + random.randint(0, 1)] = random.choice(["", "b", "é", "q"])
        written.append("".join(word))
    got = names.match_names(
        spark.createDataFrame([(w, 1) for w in written] * 2, "name string, alias int").repartition(3),
        spark.createDataFrame(aliases, "alias string, launch_id long"),
    )
    want = {}
    for w in {w for w in written if w is not None}:
        word = w.strip().lower()
        near = []
        for alias, launch in aliases:
            if alias is not None:
                a = alias.strip().lower()
                n = errors(word, a)
                if n <= (2 if len(a) >= 7 else 1 if len(a) >= 4 else 0):
                    near.append((n, launch))
        if near:
            want[w] = min(near)
    rows = got.collect()
    assert {r.name: (r.errors, r.launch_id) for r in rows} == want and len(rows) == len(want)
    assert want["sopt"] == (1, 99) and "sxpxt" not in want


def test_names_are_joined_by_equality(spark):
    df = spark.createDataFrame([("sopot", 1)], "alias string, launch_id long")
    plan = names.match_names(df.withColumnRenamed("alias", "name"), df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert names.match_names(df.withColumnRenamed("alias", "name"), df.limit(0)).collect() == []


def test_bucketed_table_is_not_moved(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 40 AS site_id", "date_add(DATE'2024-01-01', int(id div 40)) AS forecast_date", "id AS run_id")
    table = tables.save_bucketed(rows, "bucketed_predictions", str(tmp_path / "bucketed"), 4)
    asked = spark.range(900).selectExpr("id AS request_id", "IF(id % 3 = 0, 1, id % 50) AS site_id", "date_add(DATE'2024-01-01', int(id % 90)) AS forecast_date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            found = lookups.point_lookup_in_place(asked, table)
            want = lookups.point_lookup(asked, rows)
            assert sorted(map(tuple, found.select("request_id", "run_id").collect())) == sorted(map(tuple, want.select("request_id", "run_id").collect()))
            plan = table.join(asked.select("site_id", "forecast_date").distinct(), ["site_id", "forecast_date"], "left_semi")._jdf.queryExecution().executedPlan().toString()
            assert limit == before or "Bucketed: true" in plan
            scan = [line for line in plan.split("\n") if "FileScan parquet" in line][0]
            depth = len(scan) - len(scan.lstrip(" :+-|"))
            path = plan[: plan.index(scan)].split("\n")
            # Lines above the scan with less indent are its ancestors.
            ancestors = []
            for line in reversed(path):
                own = len(line) - len(line.lstrip(" :+-|"))
                if line.strip() and own < depth:
                    ancestors.append(line)
                    depth = own
            assert ancestors and not any("Exchange" in line for line in ancestors)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_predictions")

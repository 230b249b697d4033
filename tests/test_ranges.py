"""As-of join, exact ranks, duplicates within a tolerance, chances from earlier days, alerts by table."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from liftline.operators import alerts, asof, backtest, baselines, flights, ranks

START = dt.datetime(2024, 3, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("bucket", [3600, 60, 10**7])
def test_as_of_join_equals_brute_force(spark, bucket):
    """A third of all rows at one site; ties, exact instants, gaps of many buckets, null keys."""
    random.seed(bucket)
    site = lambda: 1 if random.random() < 0.34 else random.choice([2, 3, 4, None])
    facts = [(i, site(), random.choice([None, random.randint(-500, 9000)])) for i in range(600)]
    versions = [(site(), random.choice([None, *random.sample(range(0, 8000, 5), 9)]), random.randint(0, 9), float(i)) for i in range(500)]
    facts += [(1000, 1, 0), (1001, 9, 50)]
    versions += [(1, 0, 5, 1.5), (1, 0, 5, 2.5)]
    f = spark.createDataFrame([(i, s, at(m), "x") for i, s, m in facts], "id long, site long, seen timestamp, _t string").repartition(3)
    v = spark.createDataFrame([(s, at(m), run, x) for s, m, run, x in versions], "site long, made timestamp, run long, value double")
    got = asof.as_of_join(f, v, ["site"], "seen", "made", ["made", "value"], ["run", "value"], bucket).collect()
    assert sorted(r.id for r in got) == sorted(i for i, *_ in facts)
    by_site = {}
    for s, m, run, x in versions:
        if s is not None and m is not None:
            by_site.setdefault(s, []).append((m, run, x))
    for rows in by_site.values():
        rows.sort()
    for r in got:
        _, s, m = facts[r.id] if r.id < 600 else facts[r.id - 400]
        known = by_site.get(s, [])
        n = 0 if m is None else bisect.bisect_right(known, (m, 10**9, 0.0))
        want = (at(known[n - 1][0]), known[n - 1][2]) if n else None
        assert (None if r.found is None else tuple(r.found)) == want


def test_as_of_join_never_sorts_a_whole_key(spark):
    f = spark.createDataFrame([(1, at(5))], "site long, seen timestamp")
    v = spark.createDataFrame([(1, at(1), 2.0)], "site long, made timestamp, value double")
    plan = asof.as_of_join(f, v, ["site"], "seen", "made", ["value"], ["value"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) == 2 and sum("_bucket" in w.rsplit("], [", 2)[1] for w in windows) == 1
    # The other window, by key alone, stands on one row per bucket.
    assert "Aggregate" in plan[plan.index(next(w for w in windows if "_last" in w)) :]


def test_numbers_and_bins_equal_one_sort(spark):
    random.seed(2)
    rows = [(None if i % 50 == 0 else ("hot" if i % 3 == 0 else f"k{i % 7}"), random.choice([None, 0.5, 1.5, random.random()]), i) for i in range(1003)]
    df = spark.createDataFrame(rows, "k string, v double, id long").repartition(4)
    got = ranks.numbered(df, ["k"], ["v", "id"]).withColumn("bin", ranks.equal_count_bin(F.col("number"), F.col("total"), 10))
    want = df.selectExpr(
        "id", "row_number() over (partition by k order by v asc nulls first, id) as number",
        "count(*) over (partition by k) as total", "ntile(10) over (partition by k order by v asc nulls first, id) as bin",
    )
    assert sorted((r.id, r.number, r.total, r.bin) for r in got.collect()) == sorted(map(tuple, want.collect()))
    assert ranks.numbered(df.limit(0), ["k"], ["v", "id"]).collect() == []
    for n in range(1, 25):
        bins = spark.range(1, n + 1).select(ranks.equal_count_bin(F.col("id"), F.lit(n), 10).alias("b"), F.ntile(10).over(Window.orderBy("id")).alias("t"))
        assert all(r.b == r.t for r in bins.collect())


def test_calibration_has_no_window_over_all_rows(spark):
    rows = spark.createDataFrame([(i, dt.date(2024, 1, 1 + i % 9), 100, float(i % 40), i % 3 == 0) for i in range(95)], "site_id long, forecast_date date, threshold_km int, chance_pct double, reached boolean")
    found = backtest.calibration(rows)
    assert sorted((r.bin, r.n_examples) for r in found.collect()) == [(b, 10 if b <= 5 else 9) for b in range(1, 11)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def flight_rows(cases):
    return [(i, 1, dt.date(2024, 1, 1), p, km, None if i % 4 == 0 else "u", START + dt.timedelta(hours=-i)) for i, (p, km) in enumerate(cases)]


def test_duplicates_within_a_tolerance(spark):
    random.seed(6)
    cases = [(1, 99.94), (1, 99.96), (1, 100.06), (1, 100.161), (1, 100.262), (2, 5.0), (2, 5.1), (2, 5.2), (2, 5.301), (3, None), (3, None), (3, 0.0)]
    cases += [(10 + i % 3, round(random.uniform(0, 8), 3)) for i in range(150)]
    schema = "flight_id long, site_id long, flight_date date, pilot_key long, distance_km double, source_url string, retrieved_at timestamp"
    rows = flight_rows(cases)
    got = flights.without_duplicates(spark.createDataFrame(rows, schema).repartition(5))
    want = []
    for pilot in {p for p, _ in cases}:
        own = sorted((r for r in rows if r[3] == pilot), key=lambda r: (r[4] is not None, r[4] or 0))
        chains = []
        for r in own:
            m = None if r[4] is None else round(r[4] * 1000)
            last = None if not chains else chains[-1][-1][1]
            if chains and (m is None or (last is not None and m - last <= 100)):
                chains[-1].append((r, m))
            else:
                chains.append([(r, m)])
        for chain in chains:
            first = min((r for r, _ in chain), key=lambda r: (r[6], r[0]))
            ends = [m for _, m in chain if m is not None]
            want.append((pilot, first[0], first[4], len(chain), sum(r[5] is None for r, _ in chain), min(ends) / 1000 if ends else None, max(ends) / 1000 if ends else None))
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    found = [(r.pilot_key, r.flight_id, r.distance_km, r.copies, r.untraceable, r.least_km, r.largest_km) for r in got.collect()]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert (1, 2, 100.06, 3, 1, 99.94, 100.06) in found


def test_no_day_sees_itself_or_a_later_one(spark):
    random.seed(9)
    days = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=d), random.choice([None, 20.0]), 18.0 - random.randint(0, 3), random.uniform(0, 900)) for s in range(8) for d in range(20) if random.random() < 0.8]
    best = {(s, d): random.uniform(50, 350) for s, d, *_ in days if random.random() < 0.7}
    df = spark.createDataFrame(days, "site_id long, valid_date date, temp_c double, dew_point_c double, cape_j_per_kg double")
    flown = spark.createDataFrame([(s, d, km) for (s, d), km in best.items()], "site_id long, valid_date date, best_km double")
    got = baselines.chances_from_earlier_days(df, flown).collect()
    assert len(got) == len(days)
    bucket = {(r.site_id, r.valid_date): (r.cape_bucket, r.spread_bucket) for r in got}
    for r in got:
        past = [k for k in bucket if k[1] < r.valid_date and bucket[k] == (r.cape_bucket, r.spread_bucket)]
        if not past:
            assert (r.n_examples, r.p100, r.confidence_level) == (None, None, None)
            continue
        assert r.n_examples == len(past)
        for km in (100, 200, 300):
            assert r[f"p{km}"] == pytest.approx((sum(best.get(k, 0) >= km for k in past) + 1) / (len(past) + 2) * 100)


@pytest.mark.parametrize("bucket", [1, 30, 400])
def test_thresholds_in_force_equal_brute_force(spark, bucket):
    random.seed(bucket)
    day = lambda n: None if n is None else dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rules = []
    for i in range(120):
        a, b = random.choice([None, random.randint(-40, 80)]), random.choice([None, random.randint(-40, 120)])
        rules.append((i, random.choice([None, 1, 1, 2, 3]), random.choice([100, 200]), float(i), day(a), day(b)))
    rows = [(i, random.choice([1, 2, 3, 4, None]), random.choice([100, 200, 300]), day(random.randint(0, 90))) for i in range(300)]
    r = spark.createDataFrame(rules, "rule_id long, site_id long, threshold_km int, threshold_pct double, valid_from date, valid_to date")
    asked = spark.createDataFrame(rows, "run_id long, site_id long, threshold_km int, day date").repartition(3)
    got = {x.run_id: x.rule_id for x in alerts.thresholds_in_force(asked, r, "day", bucket).collect()}
    want = {}
    for run, site, km, d in rows:
        held = [x for x in rules if x[2] == km and x[1] in (None, site) and (x[4] is None or x[4] <= d) and (x[5] is None or x[5] > d)]
        if held:
            want[run] = max(held, key=lambda x: (x[1] is not None, x[4] or dt.date.min, x[0]))[0]
    assert got == want and len(want) > 100
    assert alerts.thresholds_in_force(asked.limit(0), r, "day", bucket).collect() == []


def alert(run, site, day, pct, hour):
    return (run, site, dt.date(2024, 7, day), START + dt.timedelta(hours=hour), dt.date(2024, 7, 1), 100, 50.0, pct, f"alert {run}")


SCHEMA = "run_id long, site_id long, forecast_date date, generated_at timestamp, created_date date, threshold_km int, threshold_pct double, chance_pct double, message string"


def test_nothing_is_sent_twice(spark, tmp_path):
    store = alerts.sent_alerts(spark, str(tmp_path / "sent"))
    first = spark.createDataFrame([alert(1, 1, 5, 60.0, 1), alert(2, 2, 5, 60.0, 1), alert(3, 1, 6, 60.0, 1)], SCHEMA)
    assert sorted(r.run_id for r in alerts.send_alerts(first, store, "a").collect()) == [1, 2, 3]
    # The same batch again, and its alerts under another name.
    assert sorted(r.run_id for r in alerts.send_alerts(first, store, "a").collect()) == [1, 2, 3]
    assert alerts.send_alerts(first, store, "b").collect() == [] and store.versions() == [1]
    second = spark.createDataFrame([alert(4, 1, 5, 69.9, 2), alert(5, 2, 5, 70.0, 2), alert(6, 2, 5, 75.0, 3), alert(7, 3, 5, 50.0, 2)], SCHEMA)
    assert sorted((r.run_id, r.refreshed) for r in alerts.send_alerts(second, store, "c").collect()) == [(5, True), (7, False)]
    assert sorted(r.run_id for r in store.read().collect()) == [1, 3, 5, 7]
    assert sorted(r.run_id for r in alerts.send_alerts(first, store, "a").collect()) == [1, 2, 3]
    # Dates that the second batch did not have are still those of the first.
    commits = dict((v, c) for c, v in store._entries(None))
    assert commits["2024-07-06"] == dict((v, c) for c, v in store._entries(1))["2024-07-06"] != commits["2024-07-05"]


def test_daily_list_pages(spark):
    rows = [alert(i, i % 7, 2 + i % 20, 60.0, 1) for i in range(123)]
    pages = alerts.daily_list(spark.createDataFrame(rows, SCHEMA).repartition(4), 50).orderBy("page").collect()
    assert [(r.page, r.n_pages, r.n_alerts, r.first_number) for r in pages] == [(1, 3, 123, 1), (2, 3, 123, 51), (3, 3, 123, 101)]
    order = sorted(rows, key=lambda r: (r[1], r[2], r[5], r[0]))
    assert "\n".join(r.text for r in pages).split("\n") == [f"{n}. {r[8]}" for n, r in enumerate(order, 1)]

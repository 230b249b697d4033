"""Nearest catchments where launches are crowded, against brute force."""

import math
import random

from pyspark.sql import functions as F

from liftline.operators import catchments, flights

FLOWN = "flight_id long, launch_area string, start_latitude double, start_longitude double"
LAUNCHES = "launch_id long, latitude double, longitude double, radius_km double"


def kilometres(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    half = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return round(2 * catchments.EARTH_RADIUS_KM * math.asin(math.sqrt(min(half, 1.0))), 6)


def crowd(rng, n, spread):
    """Places around one point, a third of them scattered wide."""
    return [(42.3 + rng.gauss(0, spread if i % 3 else 0.2), 24.4 + rng.gauss(0, spread if i % 3 else 0.2)) for i in range(n)]


def nearest(flown, launches):
    """Distance and id per flight; a null id comes before all others."""
    good = [x for x in launches if None not in x[1:]]
    found = {}
    for flight, _area, lat, lon in flown:
        reached = [(km, i is not None, i) for i, la, lo, radius in good if None not in (lat, lon) and (km := kilometres(lat, lon, la, lo)) <= radius]
        best = min(reached, default=None)
        found[flight] = (best[2], round(best[0], 3)) if best else (None, None)
    return found


def test_crowded_catchments_equal_brute_force(spark):
    """Launches at one place with other radii and ids, next to each other, without id, place or radius."""
    rng = random.Random(4)
    launches = [(i, *place, rng.choice([0.0, 0.1, 0.5, 3.0, 25.0, 90.0])) for i, place in enumerate(crowd(rng, 300, 0.01))]
    launches += [(1000 + i, *launches[i][1:3], rng.choice([0.1, 3.0, 40.0])) for i in range(0, 300, 2)]
    launches += [(-i, *launches[i][1:]) for i in range(1, 60)]
    launches += [(2000 + i, la + 1e-9, lo, r) for i, la, lo, r in launches[:60]]
    launches += [(None, *launches[7][1:3], 5.0), (3000, None, 24.4, 5.0), (3001, 42.3, None, 5.0), (3002, 42.3, 24.4, None), (3003, 42.3, 24.4, -1.0)]
    flown = [(i, None, *place) for i, place in enumerate(crowd(rng, 500, 0.02))]
    flown += [(5000 + i, None, *launches[i][1:3]) for i in range(100)] + [(6000, None, None, 24.4), (6001, None, 42.3, None), (6002, None, 95.0, 24.4)]
    got = flights.assign_launches(spark.createDataFrame(flown, FLOWN), spark.createDataFrame(launches, LAUNCHES), spark.createDataFrame([], "alias string, launch_id long"))
    rows = {r["flight_id"]: (r["launch_id"], r["distance_km"]) for r in got.collect()}
    assert rows == nearest(flown, launches)
    assert len(set(rows.values())) > 200


def test_few_launches_meet_a_flight(spark):
    """With twice the launches and flights in one cell there are no more launches per flight."""
    rng = random.Random(9)
    launches = spark.createDataFrame([(i, 42.0 + rng.random() / 2, 24.0 + rng.random() / 2, 25.0) for i in range(600)], LAUNCHES)
    flown = spark.createDataFrame([(i, None, 42.0 + rng.random() / 2, 24.0 + rng.random() / 2) for i in range(20000)], FLOWN)
    cell = catchments.finest_cell(F.col("start_latitude"), F.col("start_longitude"))
    met = []
    for part in (2, 1):
        some = flown.where(F.col("flight_id") < 20000 / part)
        near = catchments.launches_near(some, launches.where(F.col("launch_id") < 600 / part))
        met.append(some.withColumns(cell).join(near, ["cell_row", "cell_column"]).count() * part / 20000)
    assert 1 <= met[0] < 10 and met[1] < 1.2 * met[0]

"""Launches whose catchment can be the nearest of a place, on a grid that is halved where it is crowded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.operators.keyed import skew_safe_join
from liftline.session import written

EARTH_RADIUS_KM = 6371.0
CELL_DEGREES = 0.5
_CELLS_AROUND = int(360 / CELL_DEGREES)
# Halvings of a cell at most; a cell with no more launches, or flights, is not halved.
HALVINGS, FEW_LAUNCHES, FEW_FLIGHTS = 10, 8, 16
# Distances that come out of the formula are right to far less; the second in radians, more than a millimetre.
_SLACK_KM, _SLACK = 0.001, 1e-9


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(half, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)


def _cell(degrees: Column) -> Column:
    return F.floor(degrees / CELL_DEGREES).cast("int")


def finest_cell(latitude: Column, longitude: Column) -> dict[str, Column]:
    """Row and column of the finest cell of a place; shifted right, those of the larger ones."""
    size = CELL_DEGREES / 2**HALVINGS
    return {
        "cell_row": F.floor(latitude / size),
        "cell_column": F.pmod(F.floor(longitude / size), F.lit(_CELLS_AROUND << HALVINGS)),
    }


def _unit(latitude: Column, longitude: Column) -> list[Column]:
    lat, lon = F.radians(latitude), F.radians(longitude)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(Column.__add__, [x * y for x, y in zip(a, b, strict=True)])


def _catchments(launches: DataFrame) -> DataFrame:
    """Launches that can be assigned: at one place none with a wider one of less id beside it."""
    numbers = ["latitude", "longitude", "radius_km"]
    good = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in numbers]) & (F.col("radius_km") >= 0)
    # A null id is the least, as in a struct of distance and id.
    single = launches.where(good).groupBy(*numbers).agg(F.min(F.struct("launch_id")).alias("_id"))
    wider = Window.partitionBy("latitude", "longitude").orderBy(F.col("radius_km").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = single.withColumn("_wider", F.min("_id").over(wider)).where("_wider is null or _id < _wider")
    return first.select("_id.launch_id", *numbers)


def _launch_cells(launches: DataFrame) -> DataFrame:
    """Each launch once per grid cell that its catchment can touch."""
    reach_lat = F.col("radius_km") / 110.0
    widest = F.cos(F.radians(F.least(F.abs("latitude") + reach_lat, F.lit(89.0))))
    reach_lon = F.least(F.col("radius_km") / (110.0 * widest), F.lit(179.0))
    rows = F.sequence(_cell(F.col("latitude") - reach_lat), _cell(F.col("latitude") + reach_lat))
    columns = F.sequence(_cell(F.col("longitude") - reach_lon), _cell(F.col("longitude") + reach_lon))
    # Columns wrap at the date line; distinct, for a catchment around the globe.
    wrapped = F.array_distinct(F.transform(columns, lambda c: F.pmod(c, F.lit(_CELLS_AROUND))))
    place = _unit(F.col("latitude"), F.col("longitude"))
    return launches.select(
        "launch_id",
        F.col("latitude").alias("_lat"),
        F.col("longitude").alias("_lon"),
        "radius_km",
        *[c.alias(n) for c, n in zip(place, ("_x", "_y", "_z"), strict=True)],
        F.explode(rows.cast("array<long>")).alias("row"),
        wrapped.cast("array<long>").alias("_columns"),
    ).withColumn("column", F.explode("_columns")).drop("_columns")


def _possible(near: DataFrame, size: float) -> DataFrame:
    """Of the launches ``near`` a cell those that can be the nearest for a place in it.

    A launch that cannot reach the cell goes. One whose catchment holds the whole cell stands
    against all others: the nearest such to the centre, ``best``. A launch that is farther than
    ``best`` from every place of the cell, by more than distances are rounded, goes as well.
    Places of the cell are at most ``reach`` (radians) from its centre.
    """
    half = F.radians(F.lit(size / 2))
    latitude, longitude = (F.col("row") + 0.5) * size, (F.col("column") + 0.5) * size
    reach = half * F.sqrt(1 + F.pow(F.least(F.abs(F.cos(F.radians(latitude))) + half, F.lit(1.0)), 2)) * (1 + 1e-9)
    from_centre = haversine_km(latitude, longitude, F.col("_lat"), F.col("_lon"))
    measured = near.withColumns({"_reach": reach, "_from_centre": from_centre})
    beyond = F.col("_reach") * EARTH_RADIUS_KM + _SLACK_KM
    able = measured.where(F.col("_from_centre") <= F.col("radius_km") + beyond)
    whole = F.when(F.col("_from_centre") + beyond <= F.col("radius_km"), F.struct("_from_centre", "_x", "_y", "_z"))
    best = able.groupBy("row", "column").agg(F.min(whole).alias("best"))
    centre = _unit(latitude, longitude)
    ahead = [F.col(f"best.{c}") - F.col(c) for c in ("_x", "_y", "_z")]
    farther = _dot(centre, ahead) > F.col("_reach") * F.sqrt(_dot(ahead, ahead)) + _SLACK
    # Distances to the other side of the globe are less exact.
    beaten = (F.col("best._from_centre") < 17000) & farther
    left = skew_safe_join(able, best, ["row", "column"], "inner").where(~F.coalesce(beaten, F.lit(False)))
    return left.select(*near.columns)


def launches_near(flights: DataFrame, launches: DataFrame) -> DataFrame:
    """``cell_row``, ``cell_column``, ``launch_id``, ``_lat``, ``_lon``, ``radius_km``: by finest
    cell that holds flights, all launches that can be the nearest catchment of a place in it.

    Launches and flights meet in cells of half a degree first. What cannot be the nearest in a
    cell goes; a cell that keeps many launches and holds many flights is cut into four, its
    launches are tried again in each, and so on down to the finest. Flights are counted
    per finest cell in the input tasks, and all that follows works on cells. The finest cells keep
    what they have, however much that is: nothing is cut off.
    """
    start = finest_cell(F.col("start_latitude"), F.col("start_longitude"))
    placed = flights.where("start_latitude is not null and start_longitude is not null")
    flown = written(placed.groupBy(*[c.alias(n) for n, c in start.items()]).agg(F.count("*").alias("n_flights")), "flown")
    near, found = _launch_cells(_catchments(launches)), []
    for level in range(HALVINGS + 1):
        shifts = [F.shiftright(c, HALVINGS - level).alias(n) for c, n in (("cell_row", "row"), ("cell_column", "column"))]
        cells = flown.groupBy(*shifts).agg(F.sum("n_flights").alias("n_flights"))
        kept = written(_possible(skew_safe_join(near, cells, ["row", "column"], "inner"), CELL_DEGREES / 2**level), "near")
        counted = kept.groupBy("row", "column", "n_flights").agg(F.count("*").alias("n_launches"))
        crowded = (F.col("n_launches") > FEW_LAUNCHES) & (F.col("n_flights") > FEW_FLIGHTS) & F.lit(level < HALVINGS)
        halved = written(counted.where(crowded).select("row", "column"), "halved")
        ready = skew_safe_join(kept, halved, ["row", "column"], "left_anti")
        places = flown.select("cell_row", "cell_column", *shifts)
        found.append(skew_safe_join(places, ready.select("row", "column", "launch_id", "_lat", "_lon", "radius_km"), ["row", "column"], "inner"))
        if halved.isEmpty():
            break
        near = skew_safe_join(kept, halved, ["row", "column"], "left_semi").drop("n_flights")
        for name in ("row", "column"):
            near = near.withColumn(name, F.explode(F.array(F.col(name) * 2, F.col(name) * 2 + 1)))
    return reduce(DataFrame.unionByName, found).drop("row", "column")

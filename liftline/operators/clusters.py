"""Density clusters of places on a grid that wraps at the date line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.operators.keyed import skew_safe_join
from liftline.session import written


def least_reachable(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the least node each node of ``edges`` (``a``, ``b``) can reach.

    Each round a node takes the least label beside it, and then the label of that label,
    so that long chains take few rounds. One number per round reaches the driver.
    """
    links = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = written(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        beside = labels.select(F.col("node").alias("b"), "label")
        near = links.join(beside, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").withColumn("low", F.least("label", "near"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("root"))
        after = written(lower.join(jump, "low").select("node", F.least("low", "root").alias("label"), F.col("label").alias("before")), "labels")
        labels = after.select("node", "label")
        if after.where("label <> before").isEmpty():
            return labels


def grid_cell(latitude: Column, longitude: Column, degrees: float) -> Column:
    """Number of the cell of a place, row by row from the south; null without a place."""
    around = round(360 / degrees)
    row = F.floor((latitude + 90) / degrees)
    return (row * around + F.pmod(F.floor((longitude + 180) / degrees), F.lit(around))).cast("long")


def _beside(cell: Column, degrees: float) -> Column:
    """The eight cells around a cell; rows beyond the poles are left out."""
    around, rows = round(360 / degrees), round(180 / degrees)
    row, column = F.floor(cell / around), cell % around
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    cells = F.array(
        *[
            F.when((row + i >= 0) & (row + i <= rows), ((row + i) * around + F.pmod(column + j, F.lit(around))).cast("long"))
            for i, j in steps
        ]
    )
    return F.array_distinct(F.array_compact(cells))


def dense_cells(places: DataFrame, latitude: str, longitude: str, degrees: float, least: int) -> DataFrame:
    """``cell``, ``cluster_id``, ``n_places``, ``core`` of the cells that belong to a cluster.

    A cell with at least ``least`` places is a core; cores that touch, at a corner too, are one
    cluster, named after its least core. A cell with fewer places that touches cores belongs
    to the least of their clusters, and joins none. Places are counted per cell in the input
    tasks; all that follows works on cells, of which the globe has a fixed number.
    """
    cell = grid_cell(F.col(latitude), F.col(longitude), degrees)
    counted = places.where(cell.isNotNull()).groupBy(cell.alias("cell")).agg(F.count("*").alias("n_places"))
    counted = written(counted, "cells")
    cores = counted.where(F.col("n_places") >= least).select("cell")
    around = cores.select(F.col("cell").alias("core_cell"), F.explode(_beside(F.col("cell"), degrees)).alias("cell"))
    touching = around.join(cores, "cell").select(F.col("core_cell").alias("a"), F.col("cell").alias("b"))
    joined = least_reachable(touching).select(F.col("node").alias("cell"), "label")
    named = cores.join(joined, "cell", "left").select("cell", F.coalesce("label", "cell").alias("cluster_id"))
    named = written(named, "cores")
    edge = around.join(named.withColumnRenamed("cell", "core_cell"), "core_cell").groupBy("cell").agg(F.min("cluster_id").alias("edge_id"))
    found = counted.join(named, "cell", "left").join(edge, "cell", "left")
    return found.select(
        "cell", F.coalesce("cluster_id", "edge_id").alias("cluster_id"), "n_places", F.col("cluster_id").isNotNull().alias("core")
    ).where("cluster_id is not null")


def with_cluster(rows: DataFrame, cells: DataFrame, latitude: str, longitude: str, degrees: float, name: str) -> DataFrame:
    """``rows`` with the cluster of their place as ``name``; null outside of all and without a place."""
    own = rows.withColumn("_cell", grid_cell(F.col(latitude), F.col(longitude), degrees))
    lookup = cells.select(F.col("cell").alias("_cell"), F.col("cluster_id").alias(name))
    return skew_safe_join(own, lookup, ["_cell"]).drop("_cell")


# Cells of a cluster and of a region, in degrees, and the places that make a cell dense.
CLUSTER, REGION = (0.05, 5), (0.5, 20)


def assign_areas(
    flights: DataFrame, launches: DataFrame, cluster: tuple[float, int] = CLUSTER, region: tuple[float, int] = REGION
) -> DataFrame:
    """``flight_id``, ``cluster_id``, ``region_id``, ``launch_id``, ``area`` of flights by where they started.

    Clusters and regions are density clusters of the starts, in small and in large cells.
    ``launch_id`` is the least launch (launch_id, latitude, longitude) that lies in the same
    cluster, else in the same region; ``area`` says which: cluster, region or none.
    """
    placed, start = flights.select("flight_id", "start_latitude", "start_longitude"), ("start_latitude", "start_longitude")
    found = placed
    sites = launches.select("launch_id", "latitude", "longitude")
    for name, (degrees, least) in (("cluster", cluster), ("region", region)):
        cells = dense_cells(placed, *start, degrees, least)
        found = with_cluster(found, cells, *start, degrees, f"{name}_id")
        own = with_cluster(sites, cells, "latitude", "longitude", degrees, f"{name}_id")
        first = own.where(f"{name}_id is not null").groupBy(f"{name}_id").agg(F.min("launch_id").alias(f"_{name}"))
        found = skew_safe_join(found, first, [f"{name}_id"])
    area = F.when(F.col("_cluster").isNotNull(), "cluster").when(F.col("_region").isNotNull(), "region").otherwise("none")
    return found.select("flight_id", "cluster_id", "region_id", F.coalesce("_cluster", "_region").alias("launch_id"), area.alias("area"))

"""Helpers the operators share: tables, scratch tables, exact connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.session import configure

WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings, and this package on the path of Python workers that start here."""
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = paths.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        paths["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a lone local session gets one in its warehouse."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def settle(rows: DataFrame, name: str) -> DataFrame:
    """Writes ``rows`` once as Parquet in the shared scratch folder and reads them back.

    Cuts the lineage of results that are read several times. The files outlive lost
    executors; the folder belongs to the application and goes with its checkpoints.
    """
    path = f"{scratch_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = rows.schema
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Least node reachable from each node: columns ``node``, ``component``.

    ``edges`` has the long columns ``a`` and ``b``; direction, loops and repeats do not
    matter. Each round every node takes the least label next to it (minimum, reduced in
    the input tasks) and then the label of its label, so chains shorten geometrically.
    Only one number per round reaches the driver. A node of very many edges is reduced
    before each shuffle of its own and its rows are split by AQE in the joins.
    """
    both = edges.where("a <> b").select("a", "b")
    both = settle(both.union(both.select("b", "a")).distinct(), f"{name}-edges")
    labels = settle(
        both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("component")
        ),
        f"{name}-labels",
    )
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        near = both.join(of, "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.least("component", "near").alias("component"),
            F.col("component").alias("before"),
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = settle(
            lower.join(jump, "component").select(
                "node", F.least("component", "root").alias("component"), "before"
            ),
            f"{name}-labels",
        )
        changed = after.where("component <> before").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels


def contracted(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Edges ``a``, ``b`` that connect the same nodes, in stars: fewer rounds for ``components``.

    A task takes up to ``most`` of its edges at a time and ties each node that they connect
    to the least one of them.
    """

    def stars(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        tied = [(x, root(x)) for x in list(up) if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([t[i] for t in tied], pa.int64()) for i in (0, 1)], ["a", "b"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for batch in batches:
            pairs += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            if len(pairs) >= most:
                yield stars(pairs)
                pairs = []
        yield stars(pairs)

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")

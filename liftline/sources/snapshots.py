"""Versioned Parquet tables: immutable commits and one manifest per version.

A write puts whole partitions into a folder of its own (a commit) and then publishes a
manifest that says, for every partition of the new version, which commit has it. The
manifest appears by one rename, so a reader sees a version whole or not at all, and a write
that is interrupted before leaves nothing but files that no manifest names. Earlier versions
stay readable, and nobody waits for a lock.

What the driver handles is a row per partition of the table, never files or rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftline.operators.keyed import latest_per_key

COMMIT = "commit_id"
_MANIFEST = "commit string, value string, note string"


def _path(spark: SparkSession, path: str):
    """Hadoop file system and path, so that any store Spark reads will do."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


class VersionTaken(RuntimeError):
    """Another job published this version first; the write can be run again."""


@dataclass(frozen=True)
class Snapshots:
    """A table at ``root`` with columns ``schema``, partitioned by the column ``partition``."""

    spark: SparkSession
    root: str
    schema: T.StructType
    partition: str

    def versions(self) -> list[int]:
        """Published versions, from 1."""
        fs, folder = _path(self.spark, f"{self.root}/_versions")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))

    def _entries(self, version: int | None) -> list[tuple[str, str | None]]:
        """(commit, partition value as text) of a version; of none before the first."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return []
        if version not in known:
            raise ValueError(f"There is no version {version}; the last is {known[-1] if known else 0}.")
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/_versions/{version:010d}.json")
        return [(r.commit, r.value) for r in rows.where("commit is not null").collect()]

    def notes(self) -> dict[int, str]:
        """What each version was published with."""
        if not self.versions():
            return {}
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/_versions").where("commit is null")
        name = F.regexp_extract("_metadata.file_name", r"^(\d+)\.json$", 1).cast("int")
        return {r.version: r.note for r in rows.select(name.alias("version"), "note").collect()}

    def read(self, version: int | None = None, only: list[str | None] | None = None) -> DataFrame:
        """The latest version, or the one asked for; with ``only``, the partitions of these values.

        Which commit holds which partition is a condition on partition columns, so files of
        other commits are left out when the query is planned, like those of partitions that
        the caller's own filters exclude.
        """
        entries = self._entries(version)
        return self._read(entries if only is None else [e for e in entries if e[1] in set(only)])

    def _read(self, entries: list[tuple[str, str | None]]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        held: dict[str, list[str | None]] = {}
        for commit, value in entries:
            held.setdefault(commit, []).append(value)
        text = F.col(f"`{self.partition}`").cast("string")

        def of(commit: str) -> Column:
            values = [v for v in held[commit] if v is not None]
            inside = text.isin(values) if values else F.lit(False)
            return (F.col(COMMIT) == commit) & (inside | text.isNull() if None in held[commit] else inside)

        schema = T.StructType([*self.schema.fields, T.StructField(COMMIT, T.StringType())])
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/data")
        rows = reader.parquet(*[f"{self.root}/data/{COMMIT}={commit}" for commit in sorted(held)])
        return rows.where(reduce(Column.__or__, map(of, sorted(held)))).select(*[f"`{n}`" for n in self.schema.names])

    def values_in(self, rows: DataFrame) -> list[str | None]:
        """The different partition values of ``rows`` as text."""
        return [r[0] for r in rows.select(F.col(f"`{self.partition}`").cast("string")).distinct().collect()]

    def _write(self, rows: DataFrame) -> str:
        """Writes a commit that nobody can see yet; a large partition becomes as many files as it needs."""
        commit = uuid.uuid4().hex
        (
            rows.hint("rebalance", self.partition)
            .write.mode("errorifexists")
            .partitionBy(self.partition)
            .parquet(f"{self.root}/data/{COMMIT}={commit}")
        )
        return commit

    def _publish(self, version: int, entries: list[tuple[str, str | None]], note: str) -> int:
        """Makes ``version`` visible; refused if it is there already."""
        draft = f"{self.root}/_drafts/{uuid.uuid4().hex}"
        rows = [(None, None, note), *[(c, v, None) for c, v in entries]]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(draft)
        fs, folder = _path(self.spark, draft)
        part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        _, target = _path(self.spark, f"{self.root}/_versions/{version:010d}.json")
        fs.mkdirs(target.getParent())
        # Renaming a file to one that exists fails in a distributed store; a local disk would overwrite.
        if fs.exists(target) or not fs.rename(part, target):
            raise VersionTaken(f"Version {version} was published by another job.")
        self._delete(draft)
        return version

    def replace(self, rows: DataFrame, note: str = "") -> int:
        """A new version in which ``rows`` are all rows of the partitions that they have."""
        version = (self.versions() or [0])[-1]
        old, commit = self._entries(version), self._write(_conform(rows, self.schema))
        # Read back what was written: ``rows`` need not give the same again.
        new = self.values_in(self._commit(commit))
        return self._publish(version + 1, [e for e in old if e[1] not in set(new)] + [(commit, v) for v in new], note)

    def _commit(self, commit: str, *more: T.StructField) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, *more])).parquet(f"{self.root}/data/{COMMIT}={commit}")

    def merge(self, rows: DataFrame, keys: list[str], newest_first: list[Column], note: str = "") -> int:
        """A new version with ``rows`` inserted by key; the newest row of a key wins.

        Of rows that ``newest_first`` ranks alike an inserted one wins, and of several the
        one of least hash. Only the partitions of ``rows`` are read, and of these only the
        ones in which something changes belong to the new version; the others are taken over
        as they are. If nothing changes there is no new version, so a batch can be run twice.
        Rows with a null key are refused. ``rows`` are computed once, into a draft.
        """
        draft = f"{self.root}/_drafts/{uuid.uuid4().hex}"
        _conform(rows, self.schema).write.parquet(draft)
        rows = self.spark.read.schema(self.schema).parquet(draft)
        version = (self.versions() or [0])[-1]
        text = F.col(f"`{self.partition}`").cast("string").alias("value")
        empty = reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in [*keys, self.partition]])
        given = rows.groupBy(text).agg(F.count_if(empty).alias("empty")).collect()
        if any(r.empty for r in given):
            raise ValueError(f"A row without {', '.join(keys)} cannot be inserted.")

        old = self.read(version, [r.value for r in given])
        names = [f"`{n}`" for n in self.schema.names]
        both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        # Equal rows have one hash, so a row that is inserted again counts as the old one.
        both = both.withColumn("_hash", F.xxhash64(*names))
        held = both.groupBy(*[f"`{k}`" for k in keys], "_hash").agg(F.min("_new").alias("_known"))
        order = [*newest_first, F.col("_new").desc(), F.col("_hash")]
        won = latest_per_key(both, keys, order).join(held, [*keys, "_hash"])
        commit = self._write(won.select(*names, "_known"))
        written = self._commit(commit, T.StructField("_known", T.IntegerType()))
        new = [r.value for r in written.groupBy(text).agg(F.max("_known").alias("new")).collect() if r.new]
        self._delete(draft)
        if not new:
            self._delete(f"{self.root}/data/{COMMIT}={commit}")
            return version
        kept = [e for e in self._entries(version) if e[1] not in set(new)]
        return self._publish(version + 1, kept + [(commit, v) for v in new], note)

    def _delete(self, path: str) -> None:
        fs, folder = _path(self.spark, path)
        fs.delete(folder, True)


def _conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    extra, absent = sorted(set(rows.columns) - set(schema.names)), sorted(set(schema.names) - set(rows.columns))
    if extra or absent:
        raise ValueError(f"Unexpected columns {extra}, absent columns {absent}.")
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])

"""The registered queries: a Spark callable and, where there is one, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftline.functions.calendar import iso_instant

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _as_text(rows: DataFrame) -> DataFrame:
    """Dates and instants as ISO text, so both engines give the same values."""
    columns = []
    for field in rows.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.TimestampType):
            column = iso_instant(column)
        columns.append(column.alias(field.name))
    return rows.select(*columns)


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice.")
        ENTRIES[name] = Entry(lambda spark, sf_dir: _as_text(function(spark, sf_dir)), sql)
        return function

    return register

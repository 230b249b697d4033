"""Runs a registered query and its SQL twin and compares the whole results."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0)
    return repr(value)


def compare(spark, connection, name: str, entry, sf_dir: str) -> str | None:
    """None when equal, else a short text with what differs."""
    rows = entry.run(spark, sf_dir)
    columns = sorted(rows.columns)
    got = [tuple(r) for r in rows.select(*[f"`{c}`" for c in columns]).collect()]
    if entry.sql is None:
        return None if got else f"{name}: no rows"
    result = connection.execute(entry.sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    if [names[i] for i in order] != columns:
        return f"{name}: columns {columns} and {[names[i] for i in order]}"
    want = [tuple(r[i] for i in order) for r in result.fetchall()]
    kinds = {c: t for c, t in rows.dtypes}
    if any(k.startswith(("array", "struct", "map", "timestamp", "date", "variant", "decimal")) for k in kinds.values()):
        return f"{name}: types that engines print differently {kinds}"
    left = Counter(tuple(map(_cell, r)) for r in got)
    right = Counter(tuple(map(_cell, r)) for r in want)
    if not got:
        return f"{name}: no rows"
    if left == right:
        return None
    only_left, only_right = list((left - right).items())[:3], list((right - left).items())[:3]
    return (
        f"{name}: {len(got)} and {len(want)} rows, {sum((left - right).values())} differ\n"
        f"  columns {columns}\n  spark  {only_left}\n  oracle {only_right}"
    )


def main() -> None:
    import sys
    import time

    from liftline.plans import all_entries
    from liftline.session import local_session

    sf_dir, picks = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    connection = connect(sf_dir)
    bad = 0
    for name, entry in all_entries().items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, name, entry, sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{name}: {type(error).__name__} {str(error)[:900]}"
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s", name, "ok" if problem is None else "FAIL", flush=True)
        if problem:
            print(problem, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()

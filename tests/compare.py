"""Hold a Spark result against DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import tempfile
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(x: object) -> object:
    """A value in a form in which both engines' values compare and sort."""
    if x is None:
        return (0,)
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, (int, float)):
        return (2, float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else str(x) if isinstance(x, float) else x)
    if isinstance(x, datetime.datetime):
        return (3, x.replace(tzinfo=None).isoformat())
    if isinstance(x, datetime.date):
        return (3, x.isoformat())
    if isinstance(x, (bytes, bytearray)):
        return (4, bytes(x).hex())
    if isinstance(x, dict):
        return (5, tuple((k, plain(v)) for k, v in sorted(x.items())))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return (6, tuple(map(plain, x)))
    return (7, str(x))


def spark_rows(df: DataFrame) -> tuple[list[str], list]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list]:
    got = connect(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def assert_same(df: DataFrame, sql: str, sf_dir: str = SF_DIR) -> int:
    columns, mine = spark_rows(df)
    names, theirs = duck_rows(sql, sf_dir)
    assert columns == names
    assert len(mine) == len(theirs), f"{len(mine)} rows, SQL has {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        assert a == b
    return len(mine)


def folder(spark, **tables: DataFrame) -> str:
    """A new folder of tables, each one Parquet folder as the queries read them."""
    at = tempfile.mkdtemp(prefix="spark-")
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}.parquet")
    return at

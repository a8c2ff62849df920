from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(warehouse))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def rows_of_sql(con, sql: str) -> list[tuple]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in found.fetchall())

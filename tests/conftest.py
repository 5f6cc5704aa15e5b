import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(home / "warehouse")).config("spark.checkpoint.dir", f"file://{home}/shared")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(df, con, sql):
    """Rows of a Spark result and of DuckDB's, columns by name, in any order."""
    got = df.toPandas()
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [sorted((tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in f[cols].astype(object).itertuples(index=False)), key=repr) for f in (got, want)]
    assert rows[0] == rows[1]

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(columns, rows):
    """Columns by name, rows sorted, values as comparable text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def shown(v):
        return f"{v:.9g}" if isinstance(v, float) else str([str(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)

    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a frame has the rows of a query in DuckDB."""

    def check(frame, sql, con=duck):
        want = con.sql(sql)
        assert normal(frame.columns, frame.collect()) == normal(want.columns, want.fetchall())

    return check

import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the smallest tables; call it with SQL and get column names and rows."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/sf0.001/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")

    def run(sql):
        found = con.sql(sql)
        return found.columns, found.fetchall()

    return run


def _plain(value):
    if isinstance(value, float) and value != value:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    return tuple(_plain(x) for x in value) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def same():
    """Holds a DataFrame against columns and rows, whatever the order."""

    def check(df, found):
        columns, rows = found
        names = sorted(df.columns)
        assert names == sorted(columns)
        at = [columns.index(c) for c in names]
        ours = sorted(repr(tuple(_plain(r[c]) for c in names)) for r in df.collect())
        theirs = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in rows)
        assert ours == theirs

    return check

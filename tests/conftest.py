import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    tmp = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp}/shared")
        .config("spark.sql.warehouse.dir", f"{tmp}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


def duck(sql: str, tables: dict | None = None):
    """The rows of a query over the small tables, or over the given pandas tables."""
    import duckdb

    con = duckdb.connect()
    if tables is None:
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    else:
        for name, frame in tables.items():
            con.register(name, frame)
    return con.execute(sql).df()


def rows(frame):
    """Rows in one form for comparison: columns by name, numbers as floats, nulls alike."""
    cols = sorted(frame.columns)

    def one(x):
        if x is None or str(x) == "<NA>" or x != x:
            return None
        if isinstance(x, str) or hasattr(x, "isoformat"):
            return str(x)
        return round(float(x), 4)

    return sorted((tuple(one(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)

"""One Spark session for all tests."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    builder = SparkSession.builder.master("local[3]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"{shared}/warehouse")
    session = builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def samples(tmp_path_factory):
    """Small files in each format: (price, quantity), and one with a discount."""
    folder = tmp_path_factory.mktemp("data")
    (folder / "test.csv").write_text("price,quantity\n10.5,3\n20.0,4\n\n15.25,2\n30.0,5\n")
    (folder / "extended.csv").write_text("price,quantity,discount\n10.5,3,0.1\n20.0,4,0.2\n15.25,2,0.05\n30.0,5,0.15\n")
    (folder / "test.json").write_text('{"price": 10.5, "quantity": 3}\n{"price": 20.0, "quantity": 4}\n{"price": 1.0}\nnot json\n{"price": 15.25, "quantity": 2}\n{"price": 30.0, "quantity": 5}\n')
    return folder


def rows_of(columns, rows):
    """Rows as a sorted list under sorted column names; floats to twelve digits."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return None if v != v else float(f"{v:.12g}")
        return v

    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)

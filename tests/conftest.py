import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp()).config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def same_as_sql(spark, query, sql, sf):
    """Whether a query's rows are those of its SQL in DuckDB."""
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = query(spark, sf)
    names = sorted(got.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    theirs = con.execute(f"SELECT {quoted} FROM ({sql}) q").fetchall()
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert key(tuple(r) for r in got.select(*names).collect()) == key(theirs)

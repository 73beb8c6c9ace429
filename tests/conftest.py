import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tests-")).config("spark.sql.warehouse.dir", tempfile.mkdtemp()).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{TESTDATA}/sf0.001"


def normal(df):
    """Rows of a pandas frame as comparable tuples, columns by name."""
    import pandas as pd

    df = df[sorted(df.columns)].astype(object)
    show = lambda v: "" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) and abs(v) < 1e8 else str(int(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df.values.tolist())


@pytest.fixture(scope="session")
def same_as_sql(spark):
    import duckdb

    def check(query, sql, sf_dir):
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)

    return check

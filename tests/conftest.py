import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in ("events", "lineitem", "documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b) -> None:
    """Equal rows in any order; floats, which queries round to six digits or more, must round alike."""
    import pandas as pd

    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns, key=lambda c: (pd.api.types.is_float_dtype(a[c]), c))
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        if pd.api.types.is_float_dtype(a[c]) or pd.api.types.is_float_dtype(b[c]):
            pd.testing.assert_series_equal(a[c].astype(float), b[c].astype(float), atol=1e-9, rtol=1e-12, check_dtype=False)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c

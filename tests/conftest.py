import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for n in NAMES:
        p = f"{SF}/{n}.parquet"
        c.execute(f"create view {n} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.fixture(scope="session")
def same():
    """Compares two pandas tables whatever the order of their rows."""

    def check(a, b):
        cols = sorted(b.columns)
        assert sorted(a.columns) == cols
        norm = lambda d: sorted(tuple(repr(None if v != v or v is None else float(v) if isinstance(v, float) else v.item() if hasattr(v, "item") else v) for v in r) for r in d[cols].astype(object).itertuples(index=False))
        x, y = norm(a), norm(b)
        assert len(x) == len(y)
        assert x == y

    return check

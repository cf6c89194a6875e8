import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


def _plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    return bytes(x) if isinstance(x, (bytearray, memoryview)) else x


@pytest.fixture(scope="session")
def parity(spark):
    """Fails unless a query gives the rows that its SQL gives, columns by name, rows in any order."""
    from collections import Counter

    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")

    def same(query, sql):
        df = query(spark, SF_DIR)
        names = sorted(df.columns)
        got = Counter(tuple(_plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == names
        order = [columns.index(c) for c in names]
        want = Counter(tuple(_plain(r[i]) for i in order) for r in found.fetchall())
        assert got == want, (sum((got - want).values()), sum((want - got).values()), next(iter((got - want).items()), None), next(iter((want - got).items()), None))
        assert got

    return same

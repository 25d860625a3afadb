import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from loomgate.session import get_session

    os.environ.setdefault("LOOMGATE_DRIVER_MEMORY", "4g")
    s = get_session(4, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def normal(rows, columns):
    """Rows as sorted tuples of text, columns in order of name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.6g}"
        return "nan" if v is None else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def agree(spark, sf_dir, duck):
    """Compares a query with its SQL on the same tables."""

    def check(query, sql):
        df = query(spark, sf_dir)
        cur = duck.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(columns)
        assert normal(df.collect(), df.columns) == normal(cur.fetchall(), columns)

    return check

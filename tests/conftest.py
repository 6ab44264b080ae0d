import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from deltaloom.session import session

    s = session("tests", spark_master="local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def same_rows(df, result):
    """Whether a DataFrame has the rows of a DuckDB result, columns by name, floats to 6 digits."""

    def norm(v):
        return f"{v:.6g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)

    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in order) for r in result.fetchall())
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    assert got == want

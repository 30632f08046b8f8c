import glob
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siltworks import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session.build(os.environ.get("TEST_CORES", "8"), "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield s


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


def duck(folder, sql):
    """Rows of the SQL over the folder's tables, as sorted tuples by column name."""
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(folder + "/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.execute(f"create view {name} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return rows(c.sql(sql).df())


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    one = lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x else f"{x:.6g}" if isinstance(x, float) and not float(x).is_integer() else str(int(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(one, r)) for r in pdf.astype(object).itertuples(index=False))

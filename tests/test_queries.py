"""Every registered query of the library against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from varispark import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return ""
        return f"{float(x):.6f}" if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)

    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLE:
        want = duck.execute(plans.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)

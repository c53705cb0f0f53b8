"""Every query with SQL gives what DuckDB gives on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from trickstat import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)]
    say = lambda v: "NULL" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{float(v):.9g}" if isinstance(v, float | np.floating) else str(v)
    return sorted(tuple(say(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n in plans.SQL])
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)

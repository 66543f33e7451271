"""Every registered query of the library against its oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from chronotext.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(pdf: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NA:
            return "null"
        return f"{round(float(v), 5):.5f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(one(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got) and not got[got.columns[0]].isna().any()

"""Registered queries against DuckDB, where SQL can say the same, and their columns."""

import duckdb
import pytest

from chronotext.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_oracle(name, spark):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = q.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(tuple(str(v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))
    assert plain(got) == plain(want)


def test_every_number_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in q.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in q.QUERIES

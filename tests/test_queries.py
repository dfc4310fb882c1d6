"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from codeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(None if x != x else round(x, 4) if isinstance(x, float) else x for x in r)) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_rows_only_queries_run(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)):
        assert catalogue.QUERIES[name](spark, SF).count() > 0

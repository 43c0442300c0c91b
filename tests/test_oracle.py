"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomwright.plans import catalog

from .conftest import SF


def rows(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 5) + 0.0 if isinstance(x, float) or hasattr(x, "dtype") and "float" in str(x.dtype) else str(x)
    return sorted((tuple(value(x) for x in r) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equal_to_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)

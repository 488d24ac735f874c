"""Every registered query against its SQL in DuckDB, values included."""

import math

import duckdb
import pandas as pd
import pytest

from lodestone import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, int | float):
            return float(round(v, 6))
        return str(v) if hasattr(v, "isoformat") else v

    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(name, spark, sf_dir, duck):
    got = plans.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(name, spark, sf_dir):
    assert plans.queries()[name](spark, sf_dir).toPandas() is not None

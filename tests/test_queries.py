"""Every core query against its SQL on the small tables, and the shape of those without SQL."""

import os

import numpy as np
import pandas as pd
import pytest

from poolaudit.plans import queries as core


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


def plain(df: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NaT:
            return "null"
        if isinstance(x, (float, np.floating)):
            return "nan" if x != x else repr(round(float(x), 9) + 0.0)
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, np.integer)):
            return str(int(x))
        return str(x)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    got, want = core.queries()[name](spark, data).toPandas(), duck.sql(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_core_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())


def test_entry_has_a_stable_schema(spark, data):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["scorer", "n_pos", "n_neg", "auroc"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

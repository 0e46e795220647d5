"""Every registered query against its DuckDB oracle on sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import digest, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    """Iterative fits: no SQL oracle; they must run on the whole tables."""
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    assert len(rows) >= 1
    for col in ("auc", "valid_loss", "train_loss"):
        if col in df.columns:
            assert all(r[col] is not None for r in rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 64 and set(df.columns) == {"feature", "mean_auc", "std_auc", "pooled_auc"}

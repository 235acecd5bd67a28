import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.plans.catalog import ORACLES, QUERIES

from .oracle import TABLES, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert_same(spark, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_metadata_text_of_odd_balances(spark, sf, tmp_path):
    """Negative zeros, missing values and large numbers read as in SQL."""
    for t in set(TABLES) - {"supplier"}:
        os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    balances = [-0.3, -0.5, -0.0, 0.0, 0.3, 2.5, -2.5, None, 12345678.6, -987654321.2, 1e15, 9999999999999998.0, 1e16, -1.25e20, 1e300, float("inf"), -float("inf"), float("nan")]
    rows = [(i, None if i == 4 else f"S{i}", None if i % 5 == 3 else i, b) for i, b in enumerate(balances)] + [(None, "no key", 1, -0.1)]
    columns = zip(("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), (pa.int64(), pa.string(), pa.int32(), pa.float64()), zip(*rows, strict=True), strict=True)
    pq.write_table(pa.table({name: pa.array(values, kind) for name, kind, values in columns}), tmp_path / "supplier.parquet")
    assert_same(spark, str(tmp_path), QUERIES["table_metadata"], ORACLES["table_metadata"])

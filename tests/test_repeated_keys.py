"""Queries whose key stands on several rows of the input give what their SQL gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SOURCE = "/root/testdata/sf0.001"
NAMES = ("prj17_decide_eligibility", "prj20_data_readiness", "sm10_comparable_facts", "sm15_readiness")


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Some lines again with other discounts and taxes, some as they are."""
    folder = tmp_path_factory.mktemp("repeated")
    for name in os.listdir(SOURCE):
        os.symlink(f"{SOURCE}/{name}", folder / name)
    os.unlink(folder / "lineitem.parquet")
    lines = f"'{SOURCE}/lineitem.parquet'"
    duckdb.sql(f"""COPY (SELECT * FROM {lines} WHERE l_orderkey % 5 < 2
     UNION ALL SELECT * REPLACE (CASE WHEN l_discount > 0.05 THEN round(l_discount - 0.05, 2) ELSE round(l_discount + 0.04, 2) END AS l_discount, CASE WHEN l_tax > 0.03 THEN round(l_tax - 0.02, 2) ELSE round(l_tax + 0.03, 2) END AS l_tax) FROM {lines} WHERE l_orderkey % 5 = 0
     UNION ALL SELECT * FROM {lines} WHERE l_orderkey % 10 = 1) TO '{folder}/lineitem.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_repeated_keys(spark, repeated, name):
    for table in os.listdir(repeated):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table[:-8]} AS SELECT * FROM '{repeated}/{table}'")
    got = entry.queries()[name](spark, repeated)
    want = duckdb.sql(entry.oracle_sql()[name])
    columns = want.columns
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    assert set(columns) == set(got.columns) and rows == sorted(map(repr, want.fetchall()))

"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from retort.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {Path(name).stem} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    wanted = tables.execute(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(wanted)


def test_entry_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with parts whose numbers have six and seven digits."""
    out = tmp_path_factory.mktemp("tables")
    for name in os.listdir(SF):
        if name != "part.parquet":
            os.symlink(f"{SF}/{name}", out / name)
    keys = "(SELECT p_partkey + step AS k FROM range(0, 1) r(x), (VALUES (100000), (100040), (1000000), (1000040)) s(step), part WHERE p_partkey < 40)"
    duckdb.execute(f"COPY (WITH part AS (SELECT * FROM '{SF}/part.parquet') SELECT part.* FROM part UNION ALL SELECT p.* REPLACE (k AS p_partkey) FROM {keys}, (SELECT * FROM part LIMIT 1) p) TO '{out}/part.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["change_feed", "history_findings", "kind_findings"])
def test_parts_with_long_numbers(spark, folder, name):
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{table}')")
    got = __spark_entry__.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)

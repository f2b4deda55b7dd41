import os
from collections import Counter

import duckdb

import __spark_entry__

SF = "/root/testdata/sf0.1"


def test_briefs_spend_what_their_sql_spends(spark):
    """At sf0.1 a brief's budget ends between an excerpt with the space before a missing tier and one without it."""
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{table}')")
    got = __spark_entry__.queries()["brief_entries"](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()['brief_entries']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)

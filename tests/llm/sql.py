"""A registered query beside its SQL."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def rows_of_sql(spark, queries, name):
    """The rows, which must be those of the SQL."""
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    result = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert len(at) == len(result.description) and found == want
    return found

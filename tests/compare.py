"""A query's rows against its SQL in DuckDB on the same tables."""

import os
from pathlib import Path

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shown(v):
    """Whole numbers as such, however they are held; other floats to six places."""
    if isinstance(v, float):
        return repr(round(v, 6)) if v != v or v != int(v) else str(int(v))
    return str(v)


def cells(table):
    """The rows of an Arrow table, in which nulls are None whatever a column's type, in one order."""
    names = sorted(table.column_names)
    return sorted(tuple(map(shown, row)) for row in zip(*(table.column(n).to_pylist() for n in names), strict=True))


def assert_same(spark, query, sql, sf_dir=SF):
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours, theirs = query(spark, sf_dir).toArrow(), db.sql(sql).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert cells(ours) == cells(theirs)

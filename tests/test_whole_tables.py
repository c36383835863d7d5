"""Registered queries hold all rows of their tables, as their SQL does."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from braidlake.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "n"), [("path_walk_text", 150), ("gaf_strand_flip", 1000), ("cs_normalize", 937), ("gaf_sort_interval", 1000)])
def test_all_rows(spark, name, n):
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, SF)
    rows = db.execute(queries.SQL[name])
    at = [got.columns.index(c[0]) for c in rows.description]
    found = Counter(tuple(r[i] for i in at) for r in got.collect())
    assert found.total() == n and found == Counter(rows.fetchall())

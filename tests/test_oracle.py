"""Queries against their SQL in DuckDB."""

import duckdb
import pytest

from sheetwright.plans import queries

def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem", "embeddings", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    d = queries.QUERIES[name](spark, sf)
    columns = sorted(d.columns)
    want = db.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain([tuple(r) for r in d.select(*columns).collect()]) == plain(want)

"""Queries of this subpackage against their SQL, on the small table and on the fixture with odd rows."""

import duckdb
import pytest

from sheetwright.llm import near, quality, queries, repeats, templates


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v) for v in r) for r in rows)


def compare(db, d, sql):
    columns = sorted(d.columns)
    want = db.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()
    assert plain([tuple(r) for r in d.select(*columns).collect()]) == plain(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    compare(db, queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("report, sql", [
    (templates.template_report, templates.SQL), (near.near_join, near.SQL), (repeats.repeat_report, repeats.SQL), (lambda d: quality.quality_report(d).drop("lost_chars"), quality.SQL),
])
def test_odd_rows(docs, rows, report, sql):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    mine = [x for x in rows if x[0] != 300] if report is repeats.repeat_report else rows
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, t, _, s, *_ in mine])
    compare(db, report(docs.where("doc_id != 300") if report is repeats.repeat_report else docs), sql)

"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessera.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def same(spark, folder, name):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    ours, theirs = QUERIES[name](spark, str(folder)), con.sql(ORACLE[name])
    columns = sorted(ours.columns)
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in ours.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(spark, SF, name)


def test_copies_and_odd_rows_match_sql(spark, docs, tmp_path):
    """Copies, null and empty texts; pages with equal payloads."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html").write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("op1_sharding", "op5_exact_dedup", "op8_warc"):
        same(spark, tmp_path, name)

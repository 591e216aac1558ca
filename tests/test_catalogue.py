"""Every named query against its SQL twin."""

from __future__ import annotations

import pandas as pd
import pytest

from catalogue_sql import ORACLE
from procura.plans.catalogue import QUERIES

duckdb = pytest.importorskip("duckdb")
TABLES = "customer orders events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    """Rows as text: NULL differs from '', and 1 from 1.0 only where both columns have no NULL."""

    def cell(v):
        if pd.isna(v):
            return None
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return int(v) if isinstance(v, float) and v == int(v) else v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(cell(v) for v in r)) for r in frame.itertuples(index=False))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_entry_lists_them(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    want = sql.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_whole_runs_have_no_cap(spark, folder, monkeypatch):
    """Skip and limit are for the page only; whole runs hand on all lots."""
    from procura.plans import catalogue, portal, review

    seen = {}

    def noted(name, whole):
        def run(*args, skip=0, limit=None, **more):
            seen[name] = limit
            return whole(*args, skip=skip, limit=limit, **more)

        return run

    monkeypatch.setattr(portal, "portal_report", noted("portal", portal.portal_report))
    monkeypatch.setattr(review, "review_folder", noted("review", review.review_folder))
    catalogue.QUERIES["portal_cycle"](spark, folder)
    catalogue.QUERIES["review_all"](spark, folder)
    assert seen == {"portal": None, "review": None}


def test_skip_and_limit_of_a_review(spark):
    from datetime import datetime

    from procura.plans import review

    lots = [(i, f"70000{i}", f"lot {i}", f"u{i}", datetime(2024, 5, 1 + i), "c", "1") for i in range(6)]
    schema = "row_number int, tender_id string, title string, url string, deadline_at timestamp_ntz, customer string, customer_inn string"
    lots = spark.createDataFrame(lots, schema)
    files = spark.createDataFrame([(f"/in/70000{i}/a.txt", bytearray(b"text")) for i in range(6)], "path string, content binary")
    ids = lambda **page: sorted(r["title"] for r in review.review_folder(files, "/in", lots, "t {x}", **page).collect())
    assert ids() == [f"lot {i}" for i in range(6)]
    assert ids(skip=2) == [f"lot {i}" for i in range(2, 6)]
    assert ids(skip=1, limit=3) == ["lot 1", "lot 2", "lot 3"]

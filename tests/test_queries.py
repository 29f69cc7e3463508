"""Every reference query against its SQL on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftable.plans import queries, render
from weftable.plans.oracles import ORACLES
from weftable.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert {c: KINDS[k] for c, k in got.dtypes} == {c[0]: str(c[1]) for c in want.description}
    assert Counter(map(tuple, got.select(*[f"`{c}`" for c in names]).collect())) == Counter(want.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize(("name", "part"), [("value_dist", "header"), ("value_dist_sorted", "header"), ("value_dist_links", "rows"), ("cell_links", "rows")])
def test_only_what_is_read_is_extracted(spark, monkeypatch, name, part):
    asked = []
    monkeypatch.setattr(queries, "extract", lambda *a, f=queries.extract, **k: asked.append(k.get("parts")) or f(*a, **k))
    QUERIES[name](spark, str(DATA))
    assert asked == [(part,)]


def test_articles_are_spread(spark):
    """Small as they are compressed, the pages stay in as many partitions as the session has for shuffles."""
    rows = spark.range(64).selectExpr("id", "id div 4 as k")
    found = render.gathered(rows, "k", ["id"], render.td(rows["id"]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1 and found.rdd.getNumPartitions() == n
    assert {r["k"]: r["rows"] for r in found.collect()} == {k: "".join(f"<td>{i}</td>" for i in range(4 * k, 4 * k + 4)) for k in range(16)}

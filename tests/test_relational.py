"""Tables of one page stay apart, and shared tables go when they are done with."""

from __future__ import annotations

from pathlib import Path

import pytest

from weftable.operators import relational as R
from weftable.operators.extract import extract
from weftable.sources import shared


@pytest.fixture(scope="module")
def two(spark):
    row = "<tr><td rowspan=2><a title={0}>{0}</a></td><td>{0}1</td></tr><tr><td>{0}2</td></tr>"
    table = "<table class=wikitable><tr><th>{0}</th><th>Same</th></tr>" + row + "<tr><th colspan=2>More</th></tr>" + row + "</table>"
    html = "<html><title>t</title><section data-mw-section-id=0>" + table.format("A") + table.format("B") + "</section></html>"
    return R.tables(extract(spark.createDataFrame([(7, html)], "page_id int, html string")), "page_id").cache()


def test_cells_are_told_apart(two):
    cells = R.cells(two, "page_id")
    assert cells.columns[:4] == ["page_id", "section_ord", "table_ord", "sub_id"]
    assert cells.filter("is_first").count() == 12 and cells.count() == 16
    assert cells.filter("is_first").select("table_ord", "sub_id", "cell_uid").distinct().count() == 12


def test_links_and_histograms_of_each_table(two):
    links = sorted((r.table_ord, r.sub_id, r.structured) for r in R.links(R.cells(two, "page_id"), "page_id").collect())
    assert links == [(0, 0, "A"), (0, 1, "A"), (1, 0, "B"), (1, 1, "B")]
    counts = {(r.table_ord, r.sub_id, r.column, r.value): r["count"] for r in R.value_histogram(R.cells(two, "page_id"), "page_id").collect()}
    assert counts[0, 0, "A", "A"] == counts[1, 0, "B", "B"] == 1 and (0, 1, "More", "A") in counts
    assert {v for (t, *_, v) in counts if t == 1} == {"B", "B1", "B2"}


def test_find_column_in_each_table(two):
    found = {(r.table_ord, r.sub_id): r.col_index for r in R.find_column(R.leaf_headers(two, "page_id"), "Same", "page_id").collect()}
    assert found == {(0, 0): 1, (1, 0): 1}


def test_scratch_removes_what_it_made(spark, tmp_path):
    with shared.scratch(spark) as s:
        inner = shared.written(spark.range(3), "inner")
        path = inner.inputFiles()[0].removeprefix("file:")
        assert Path(path).exists()
        kept = s.result(inner.selectExpr("id * 2 as id"), "kept")
    assert not Path(path).exists()
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4]
    with pytest.raises(ZeroDivisionError), shared.scratch(spark):
        path = shared.written(spark.range(1), "lost").inputFiles()[0].removeprefix("file:")
        1 / 0
    assert not Path(path).exists()


def test_batches_are_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with shared.small_batches(spark, 7):
        assert spark.conf.get(key) == "7"
        with shared.small_batches(spark, 9):
            assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before

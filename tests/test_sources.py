from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftable import cli
from weftable.operators import relational as R
from weftable.operators.extract import extract, page_links
from weftable.sources import crawler, readers, writers
from weftable.streaming.articles import stream_articles, stream_to_json

TABLE = '<table class="wikitable"><tr><th>A</th><th>A</th></tr><tr><td>1 é</td><td><a title="T">2</a></td></tr></table>'
PAGE = f"<title>Some page</title><section><h2>S</h2>{TABLE}</section>"
BAD = '<title>Bad</title><section><h2>S</h2><table class="wikitable"><tr><th>A</th></tr><tr><td>1</td><td>2</td></tr></table></section>'


def lines_of(path) -> list[str]:
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds").write_text("a b\nc\n\na b\n")
    assert sorted(r["entity"] for r in readers.seeds(spark, str(tmp_path / "seeds")).collect()) == ["a b", "c"]


def test_crawl_keeps_failures(spark):
    def fetch(url: str) -> str:
        if "bad" in url:
            raise OSError("no")
        return f"<p>{url}</p>"

    df = spark.createDataFrame([("good one",), ("bad",)], "entity string")
    got = {r["entity"]: r for r in crawler.crawl(df, fetch, partitions=2, base="u/").collect()}
    assert got["good one"]["ok"] and got["good one"]["body"] == "<p>u/good_one</p>"
    assert not got["bad"]["ok"] and got["bad"]["error"] == "OSError: no"


def test_article_source(spark):
    class Fixed(crawler.ArticleSource):
        fetch = staticmethod(lambda url: "body of " + url)

    spark.dataSource.register(Fixed)
    got = spark.read.format("articles").option("entities", "A\nB\nA").option("base", "u/").load().collect()
    assert sorted((r["entity"], r["body"]) for r in got) == [("A", "body of u/A"), ("B", "body of u/B")]


def test_lines_to_json_and_back(spark, tmp_path):
    df = spark.createDataFrame([("e1", PAGE + "<!-- gone -->\n<p>x</p>"), ("e2", "<title>No tables</title>"), ("e3", BAD)], "entity string, html string")
    writers.write_crawl(df, str(tmp_path / "lines"))
    assert len(lines_of(tmp_path / "lines")) == 3
    articles = extract(readers.read_articles(spark, str(tmp_path / "lines")))
    found = writers.with_article_ids(articles, "source_entity")
    writers.write_article_json(found, str(tmp_path / "json"), ascii_only=True)
    text = lines_of(tmp_path / "json")
    assert all(x.isascii() for x in text)
    by = {a["entity"]: a for a in map(json.loads, text)}
    assert set(by) == {"Some_page", "No_tables", "Bad"} and by["No_tables"]["sections"] == [] and by["Bad"]["sections"][0]["tables"] == []
    (t,) = by["Some_page"]["sections"][0]["tables"]
    assert t["id"] == 5_000_001 and t["rows"][0]["values"][0] == {"column": "A", "col_index": 0, "value": "1 é"}
    assert t["rows"][0]["values"][1]["structured_values"] == [{"structured": "T", "anchor": "2"}]
    back = readers.read_article_json(spark, str(tmp_path / "json"))
    assert back.count() == 3 and back.filter("entity = 'Some_page'").select(F.explode("sections.tables")).count() == 1
    writers.write_errors(R.errors(articles, "source_entity"), str(tmp_path / "errors"))
    assert json.loads(lines_of(tmp_path / "errors")[0])["reason"] == "more cells than columns"


def test_extract_takes_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "y", 2), (3, PAGE, "z", 3)], "page int, html string, entity_ string, `a.b` int")
    got = extract(df).orderBy("page").collect()
    assert [len(r["sections"]) for r in got] == [0, 0, 1] and [r["a.b"] for r in got] == [1, 2, 3]
    assert extract(df.limit(0)).count() == 0
    assert [tuple(r) for r in page_links(df.select("page", "html")).collect()] == [(3, 0, "T", "2")]


def test_dump(spark):
    df = spark.createDataFrame([(1, PAGE)], "id int, html string")
    t = R.tables(extract(df), "id")
    assert t.select(writers.dump()).first()[0] == "A\tA\n1 é\t2 T=2;"


def test_labelled_tables(spark):
    table = {"caption": "c", "id": 7, "header": [{"level": 0, "columns": [{"name": "A", "col_span": 1, "row_span": 1, "value_dist": [{"value": "1", "count": 1}]}]}], "rows": [{"row_index": 0, "values": [{"column": "A", "col_index": 0, "value": "1"}, {"column": "B", "col_index": 1, "value": "2"}, {"column": "A", "col_index": 2, "value": "3"}]}]}
    line = "\t".join(["e", "s", "7", "yes", "0.5", " <p> ", json.dumps(table), " m\v"])
    df = spark.createDataFrame([(line,), ("short",), ("e\ts\tx\ty\tz\t\t\t",)], "value string")
    a, b, c = readers.labelled_tables(df, column_meta=True).collect()
    assert (a["table_id"], a["label_confidence"], a["table_html"], a["table_markup"]) == (7, 0.5, "<p>", "m")
    assert a["table_rows"] == [{"A": "3", "B": "2"}] and a["columns"] == ["A", "B"] and a["column_meta"] == {"A": ["1"]}
    assert b["table_id"] is None and c["table_id"] is None and c["label_confidence"] is None


def test_table_pairs(spark):
    df = spark.createDataFrame([("a\tb\ts\tt\t1\t2\tequivalent",), ("a",)], "value string")
    rows = readers.table_pairs(df).collect()
    assert rows[0]["source_table_id"] == 1 and rows[0]["label"] == "equivalent" and rows[1]["matching_table_id"] is None
    tables = spark.createDataFrame([(1, "x")], "table_id int, caption string")
    got = R.pair_tables(readers.table_pairs(df).limit(1), tables).first()
    assert got["source"]["caption"] == "x" and got["matching"] is None


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(f"e1\t{PAGE}\n")
    q = stream_to_json(stream_articles(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    (tmp_path / "in/b.txt").write_text(f"e2\t{BAD}\n")
    q = stream_to_json(stream_articles(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sorted(json.loads(x)["entity"] for x in lines_of(tmp_path / "out")) == ["Bad", "Some_page"]


def test_cli(spark, tmp_path):
    (tmp_path / "lines").write_text(f"e1\t{PAGE}\ne2\t{BAD}\n")
    cli.main(["extract", "--in", str(tmp_path / "lines"), "--out", str(tmp_path / "out")])
    assert sorted(json.loads(x)["entity"] for x in lines_of(tmp_path / "out/articles")) == ["Bad", "Some_page"]
    assert len(lines_of(tmp_path / "out/errors")) == 1
    with pytest.raises(SystemExit):
        cli.main(["unknown"])


def test_table_ids_are_dense(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("k"), F.lit(0).alias("section_ord"), (F.col("id") / 50).cast("int").alias("table_ord"), F.lit(0).alias("sub_id"))
    got = R.with_table_ids(df, "k").orderBy("k", "table_ord").collect()
    assert [r["table_id"] for r in got] == list(range(5_000_001, 5_000_501))


def test_established_arguments(spark, tmp_path):
    assert cli.renamed(["-option", "crawl_table_articles", "-seed", "S", "-out", "O"]) == ["crawl", "--seed", "S", "--out", "O"]
    assert cli.renamed(["extract", "--in", "I", "--out", "O"]) == ["extract", "--in", "I", "--out", "O"]
    (tmp_path / "lines").write_text("A\t<html><title>A</title></html>\n")
    cli.main(["-option", "parse_tables", "-in", str(tmp_path / "lines"), "-out", str(tmp_path / "out")])
    assert spark.read.text(str(tmp_path / "out" / "articles")).count() == 1
    with pytest.raises(SystemExit):
        cli.main(["-option", "unknown"])


def test_failed_requests_are_tried_again():
    asked = []

    def fetch(url):
        asked.append(url)
        if len(asked) < 3:
            raise OSError("busy")
        return "page"

    assert crawler.fetched("A", fetch, tries=3, wait=0)[2:] == (True, "page", None) and len(asked) == 3
    asked.clear()
    assert crawler.fetched("A", fetch, tries=2, wait=0)[2:] == (False, None, "OSError: busy")

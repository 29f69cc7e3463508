"""Queries over the reference's own operators. Where the tables hold no HTML tables, rows are rendered as articles of a
bounded number of rows each and extracted again; oracles.py says what must come out, from the rows themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftable import schemas
from weftable.functions import features as X
from weftable.functions import nested_json as J
from weftable.functions import text as T
from weftable.operators import relational as R
from weftable.operators.extract import PARTS, extract, page_links
from weftable.plans import render as H
from weftable.sources import readers, writers
from weftable.sources.shared import scratch, shared_path, written

#: Rows of a rendered article.
ROWS = 40

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("article", F.expr(f"c_custkey div {ROWS}"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("article", F.expr(f"o_orderkey div {ROWS}"))


def head(*names: str) -> Column:
    return H.tr(*[H.th(n) for n in names])


def page(*body: Column, heading: str = "Rows") -> Column:
    return H.article(F.concat(F.lit("Article "), F.col("article").cast("string")), H.section(heading, *body))


def extracted(df: DataFrame, order: list[str], row: Column, *before: Column, mode: str = "reference", parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One article with one table for each value of the column article."""
    pages = H.gathered(df, "article", order, row)
    return extract(pages.select("article", page(H.wikitable(*before, F.col("rows"))).alias("html")), mode=mode, parts=parts)


def customer_row() -> Column:
    return H.tr(H.td(F.col("c_custkey")), H.td(F.col("c_name")), H.td(F.col("c_mktsegment")))


def customer_articles(spark: SparkSession, sf_dir: str, mode: str = "reference") -> DataFrame:
    return extracted(customers(spark, sf_dir), ["c_custkey"], customer_row(), head("Key", "Name", "Segment"), mode=mode)


# ---- HTML text ---------------------------------------------------------------------------------------------


@query
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "entity")


@query
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_comments("html")).alias("digest"))


@query
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags("html")).alias("digest"))


@query
def escape_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_newlines("html")).alias("digest"))


@query
def crawl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lines of a crawl, and these read again: the payload keeps its tab."""
    lines = table(spark, sf_dir, "pages").select(writers.crawl_line(F.col("url"), F.col("html")).alias("value"))
    return readers.article_lines(lines).select("source_entity", F.md5("html").alias("digest"))


@query
def page_link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = page_links(table(spark, sf_dir, "pages").select("page_id", "html"))
    return links.groupBy("page_id", "structured", "anchor").agg(F.count("*").alias("n"))


@query
def pages_without_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select("page_id", F.size("sections").alias("n_sections"), F.size("errors").alias("n_errors"))


@query
def seed_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = readers.distinct_seeds(table(spark, sf_dir, "part"), "p_brand")
    return seeds.select("entity", T.article_url("entity").alias("url"))


# ---- sections and tables -----------------------------------------------------------------------------------


@query
def section_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's article: a lead section, a section with one nested section for each nation, and two that are dropped."""
    nation = table(spark, sf_dir, "nation")
    small = H.wikitable(head("Key", "Name"), H.tr(H.td(F.col("n_nationkey")), H.td(F.col("n_name"))))
    nested = H.gathered(nation, "n_regionkey", ["n_nationkey"], H.section(F.col("n_name"), small, level=3))
    region = table(spark, sf_dir, "region").join(nested, F.col("r_regionkey") == F.col("n_regionkey"))
    lead = H.wikitable(head("Region"), H.tr(H.td(F.col("r_name"))))
    body = [H.section(None, lead, number=0), H.section(F.col("r_name"), F.col("rows"), number=1), H.section("Empty", H.element("p", H.text("none")), number=2), H.section(None, lead, number=3)]
    found = extract(region.select("r_regionkey", H.article(F.col("r_name"), *body).alias("html")))
    return R.sections(found, "r_regionkey").select("r_regionkey", "entity", "section_ord", "section", F.size("tables").alias("n_tables"))


@query
def table_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.tables(customer_articles(spark, sf_dir), "article").select("article", "section_ord", "section", "table_ord", "sub_id")
    found = written(found, "tables")  # numbering reads its input more than once
    return R.with_table_ids(found, "article").select("table_id", "article", "section", "table_ord", "sub_id")


@query
def skip_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every third article the table lies in a cell of another table, which is skipped."""
    pages = H.gathered(customers(spark, sf_dir), "article", ["c_custkey"], customer_row())
    inner = H.wikitable(head("Key", "Name", "Segment"), F.col("rows"))
    outer = H.wikitable(H.tr(H.element("td", inner)))
    html = page(F.when(F.pmod("article", F.lit(3)) == 0, outer).otherwise(inner))
    found = R.tables(extract(pages.select("article", html.alias("html"))), "article")
    return found.select("article", "table_ord", F.size("rows").alias("n_rows"))


@query
def bad_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with a row too wide, or with a span that is no integer, are error records."""
    wide = H.tr(H.td("1"), H.td("2"), H.td("3"), H.td("4"))
    odd = H.tr(H.td("1", colspan="2;"), H.td("3"))
    kind = F.pmod("article", F.lit(7))
    pages = H.gathered(customers(spark, sf_dir), "article", ["c_custkey"], customer_row())
    html = page(H.wikitable(head("Key", "Name", "Segment"), F.col("rows"), F.when(kind == 0, wide).when(kind == 1, odd).otherwise("")))
    return R.errors(extract(pages.select("article", html.alias("html"))), "article").select("article", "entity", "section", "table_ord", "reason")


@query
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of a run: articles, tables and failed tables."""
    wide = H.tr(H.td("1"), H.td("2"), H.td("3"), H.td("4"))
    pages = H.gathered(customers(spark, sf_dir), "article", ["c_custkey"], customer_row())
    html = page(H.wikitable(head("Key", "Name", "Segment"), F.col("rows"), F.when(F.pmod("article", F.lit(7)) == 0, wide).otherwise("")))
    each = extract(pages.select("article", html.alias("html"))).select(F.expr("aggregate(sections, 0, (n, s) -> n + size(s.tables))").alias("t"), F.size("errors").alias("e"))
    return each.agg(F.count("*").alias("n_articles"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tables"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_errors"))


# ---- headers, grids and sub-tables -------------------------------------------------------------------------

CELL = ("article", "row_index", "col_index", "column", "value")


@query
def cells_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cells(R.tables(customer_articles(spark, sf_dir), "article"), "article").select(*CELL)


def two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article for each order status; a row for each priority."""
    df = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"))
    row = H.tr(H.td(F.col("o_orderpriority")), H.td(F.col("n")), H.td(F.col("top")))
    top = H.tr(H.th("Priority", rowspan=2), H.th("Orders", colspan=2))
    return extracted(df.withColumn("article", F.col("o_orderstatus")), ["o_orderpriority"], row, top, head("Count", "Largest"))


@query
def headers_multilevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = R.tables(two_levels(spark, sf_dir), "article").select("article", F.explode("header").alias("h")).select("article", "h.level", F.explode("h.columns").alias("c"))
    return each.select("article", "level", "c.col_index", "c.name", "c.col_span", "c.row_span", F.size("c.value_dist").alias("n_values"))


@query
def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header objects: one that spans two slots is one object."""
    each = R.headers(R.tables(two_levels(spark, sf_dir), "article"), "article")
    return each.groupBy("article", "name").agg(F.countDistinct("header_uid").alias("n_objects"), F.count("*").alias("n_slots"))


def spanned(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Articles sorted by nation, whose name is one cell for all its customers in the article."""
    by = Window.partitionBy("article", "c_nationkey")
    df = customers(spark, sf_dir).withColumns({"nth": F.row_number().over(by.orderBy("c_custkey")), "many": F.count("*").over(by)})
    nation = H.td(F.col("c_nationkey"), rowspan=F.col("many").cast("string"))
    row = F.concat(F.lit("<tr>"), F.when(F.col("nth") == 1, nation).otherwise(""), H.td(F.col("c_name")), H.td(F.col("c_mktsegment")), F.lit("</tr>"))
    found = extracted(df, ["c_nationkey", "c_custkey"], row, head("Nation", "Name", "Segment"), mode=mode)
    return R.cells(R.tables(found, "article"), "article").select(*CELL, "column_at_index")


@query
def cells_rowspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanned(spark, sf_dir, "reference")


@query
def cells_rowspan_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanned(spark, sf_dir, "corrected")


@query
def cells_colspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = H.tr(H.td(F.col("c_name"), colspan=2), H.td(F.col("c_mktsegment")))
    found = extracted(customers(spark, sf_dir), ["c_custkey"], row, head("Name", "Alias", "Segment"))
    return R.cells(R.tables(found, "article"), "article").select(*CELL, "column_at_index")


@query
def header_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a header row the first data row is both."""
    first = H.tr(H.td("Key"), H.td("Name"), H.td("Segment"))
    found = extracted(customers(spark, sf_dir), ["c_custkey"], customer_row(), first)
    return R.cells(R.tables(found, "article"), "article").select(*CELL)


@query
def subtables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A divider row before each segment but the first: it heads a sub-table of its own."""
    w = Window.partitionBy("article").orderBy("c_mktsegment", "c_custkey")
    df = customers(spark, sf_dir).withColumn("before", F.lag("c_mktsegment").over(w))
    divider = H.tr(H.th(F.col("c_mktsegment"), colspan=2))
    row = F.concat(F.when(F.col("before") != F.col("c_mktsegment"), divider).otherwise(""), H.tr(H.td(F.col("c_name")), H.td(F.col("c_nationkey"))))
    found = R.tables(extracted(df, ["c_mktsegment", "c_custkey"], row, head("Name", "Nation")), "article")
    return R.cells(found, "article", "sub_id").select("article", "sub_id", "row_index", "col_index", "column", "value")


@query
def subtable_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule over rows of any table: sign-ups stand for header-only rows."""
    found = R.segments(table(spark, sf_dir, "events"), F.col("event_type") == "signup", F.col("event_type") != "signup", ["user_id"], ["ts", "event_id"], spread=True)
    return found.select("event_id", "user_id", "sub_id")


@query
def find_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two tables on a page, whose columns stand in different places."""
    leaf = R.leaf_headers(R.tables(doubled(spark, sf_dir), "article"), "article")
    one = lambda name: R.find_column(leaf, name, "article").withColumn("name", F.lit(name))
    return one("Name").unionByName(one("Segment")).select("article", "table_ord", "name", "col_index")


@query
def num_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.num_columns(R.tables(doubled(spark, sf_dir), "article")).select("article", "table_ord", "num_columns")


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of two tables: one with two columns of one name; one with the columns the other way round, and in
    every odd article with one more before them."""
    name, segment, key = H.td(F.col("c_name")), H.td(F.col("c_mktsegment")), H.td(F.col("c_custkey"))
    odd = lambda cell: F.when(F.pmod("article", F.lit(2)) == 1, cell).otherwise("")
    row = lambda *cells: F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    pages = H.gathered(customers(spark, sf_dir), "article", ["c_custkey"], row(name, segment, key), row(odd(key), segment, name))
    second = row(odd(H.th("Key")), H.th("Segment"), H.th("Name"))
    return extract(pages.select("article", page(H.wikitable(head("Name", "Segment", "Name"), F.col("rows")), H.wikitable(second, F.col("rows1"))).alias("html")))


def inherited(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Tables of two header rows, with a divider row before each segment but the first and one after the last row."""
    w = Window.partitionBy("article").orderBy("c_mktsegment", "c_custkey")
    df = customers(spark, sf_dir).withColumn("before", F.lag("c_mktsegment").over(w))
    divider = H.tr(H.th(F.col("c_mktsegment"), colspan=2))
    row = F.concat(F.when(F.col("before") != F.col("c_mktsegment"), divider).otherwise(""), H.tr(H.td(F.col("c_name")), H.td(F.col("c_nationkey"))))
    pages = H.gathered(df, "article", ["c_mktsegment", "c_custkey"], row)
    table_ = H.wikitable(H.tr(H.th("Customer", colspan=2)), head("Name", "Nation"), F.col("rows"), H.tr(H.th("End", colspan=2)))
    found = R.tables(extract(pages.select("article", page(table_).alias("html")), mode=mode), "article")
    names = lambda level: F.array_join(F.get(F.col("header"), F.lit(level))["columns"]["name"], "|")
    return found.select("article", "sub_id", F.size("rows").alias("n_rows"), F.size("header").alias("n_levels"), names(0).alias("top"), names(1).alias("leaf"))


@query
def header_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sub-table is empty: its divider has no row after it."""
    return inherited(spark, sf_dir, "reference")


@query
def header_inheritance_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inherited(spark, sf_dir, "corrected")


@query
def captions_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption and re-serialised markup; the page's attributes are unquoted and its row ends left out."""
    pages = H.gathered(customers(spark, sf_dir), "article", ["c_custkey"], F.concat(F.lit("<tr><td title='x & y'>"), H.text(F.col("c_name")), F.lit("<td>"), H.text(F.concat(F.lit("<"), "c_mktsegment", F.lit(">")))))
    caption = F.concat(F.lit("Customers  of &amp; "), F.col("article").cast("string"))
    html = F.concat(F.lit("<html><title>t</title><body><section data-mw-section-id=0><table class=wikitable><caption>"), caption, F.lit("</caption><tr><th>Name<th>Segment"), F.col("rows"), F.lit("</table></section></body></html>"))
    found = R.tables(extract(pages.select("article", html.alias("html"))), "article")
    return found.select("article", "caption", F.md5("markup").alias("digest"))


# ---- histograms, links, rows as maps -----------------------------------------------------------------------


def order_articles(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Articles of two tables, of even and of odd order keys; the first has a divider row before keys of a remainder of
    2 by 4. The second column has a titled link in every third row, an untitled one in every third. parts: what is made of
    the tables."""
    kind = F.pmod("o_orderkey", F.lit(3))
    shown = F.concat(F.lit("see "), F.col("o_orderstatus"))
    link = F.when(kind == 0, H.element("a", H.text(shown), title=F.col("o_orderpriority"))).when(kind == 1, H.element("a", H.text(shown))).otherwise(H.text(shown))
    row = H.tr(H.td(F.col("o_orderpriority")), H.element("td", link))
    of = lambda *rests: F.when(F.pmod("o_orderkey", F.lit(4)).isin(*rests), row).otherwise("")
    pages = H.gathered(orders(spark, sf_dir), "article", ["o_orderkey"], of(0), of(2), of(1, 3))
    top = head("Priority", "Link")
    first = H.wikitable(top, F.col("rows"), H.tr(H.th("Later", colspan=2)), F.col("rows1"))
    return extract(pages.select("article", page(first, H.wikitable(top, F.col("rows2"))).alias("html")), parts=parts or PARTS)


WHERE = ("article", "table_ord", "sub_id")


@query
def value_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.histograms(R.tables(order_articles(spark, sf_dir, "header"), "article"), "article")
    return found.filter("col_index = 0").select(*WHERE, "name", "value", "count")


@query
def value_dist_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms taken from cells: titles of cells with links, texts of the others."""
    found = R.value_histogram(R.cells(R.tables(order_articles(spark, sf_dir, "rows"), "article"), "article"), "article")
    return found.select(*WHERE, "column", "value", "count")


@query
def value_dist_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.histograms(R.tables(order_articles(spark, sf_dir, "header"), "article"), "article").filter("name = 'Priority'")
    return R.sorted_domain(found, *WHERE).select(*WHERE, "value", "count", "rank")


@query
def cell_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.links(R.cells(R.tables(order_articles(spark, sf_dir, "rows"), "article"), "article"), "article")
    return found.groupBy(*WHERE, "structured", "anchor").agg(F.count("*").alias("n"))


@query
def row_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.row_dicts(R.tables(doubled(spark, sf_dir), "article"), "article")
    return found.select("article", "table_ord", "row_index", F.explode("row").alias("column", "value"))


@query
def ordered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.tables(doubled(spark, sf_dir), "article")
    return found.select("article", "table_ord", F.posexplode(R.ordered_columns()).alias("pos", "column"))


@query
def column_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.tables(doubled(spark, sf_dir), "article")
    return found.select("article", "table_ord", F.explode(R.column_meta()).alias("column", "values")).select("article", "table_ord", "column", F.explode("values").alias("value"))


# ---- JSON and text forms -----------------------------------------------------------------------------------


def as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.tables(customer_articles(spark, sf_dir), "article")
    return found.select("article", J.table_json(J.table_struct(F.lit(1))).alias("json"))


@query
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = as_json(spark, sf_dir).select("article", J.load_table("json", mode="corrected").alias("t"))
    return loaded.select("article", F.explode("t.rows").alias("r")).select("article", "r.row_index", F.explode("r.values").alias("c")).select("article", "row_index", "c.col_index", "c.column", "c.value")


@query
def json_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = as_json(spark, sf_dir).select("article", J.load_table("json", counts=False, values=False).alias("t"))
    return loaded.select("article", F.col("t.id").alias("id"), F.posexplode(F.element_at("t.header", -1)["columns"]["name"]).alias("pos", "column"))


@query
def json_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as readers of the published form find them: by column name."""
    loaded = as_json(spark, sf_dir).select("article", J.load_table("json", counts=False).alias("t"))
    return loaded.select("article", F.explode(J.resolved_rows(F.col("t"))).alias("r")).select("article", "r.row_index", F.explode("r.values").alias("c")).select("article", "row_index", "c.slot", "c.col_index", "c.column", "c.value")


@query
def article_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article lines written and read by the published schema, with dense table ids."""
    found = writers.with_article_ids(written(customer_articles(spark, sf_dir), "articles"), "article")
    lines = writers.article_json(found, ascii_only=True)
    loaded = lines.select(F.from_json("value", schemas.ARTICLE).alias("a"))
    t = loaded.select("a.entity", F.explode("a.sections").alias("s")).select("entity", "s.section", F.explode("s.tables").alias("t"))
    return t.select("entity", "section", F.col("t.id").alias("table_id"), F.size("t.rows").alias("n_rows"))


@query
def article_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published corpus: articles written to files and read again by their schema."""
    with scratch(spark) as s:
        path = shared_path(spark, "article-json")
        writers.write_article_json(customer_articles(spark, sf_dir), path, ascii_only=True)
        a = readers.read_article_json(spark, path).select("entity", F.explode("sections").alias("s"))
        t = a.select("entity", "s.section", F.explode("s.tables").alias("t")).select("entity", "section", F.explode("t.rows").alias("r"))
        return s.result(t.select("entity", "section", "r.row_index", F.array_join(F.col("r.values")["value"], "|").alias("row_values")), "article-rows")


@query
def table_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in files of JSON, read with the metadata that stand beside it."""
    with scratch(spark) as s:
        path = shared_path(spark, "table-json")
        as_json(spark, sf_dir).select(F.to_json(F.struct(F.lit("Customers").alias("entity"), F.lit("Rows").alias("section"), "article", "json")).alias("value")).write.text(path)
        read = spark.read.schema("entity string, section string, article bigint, json string").json(path)
        found = readers.table_json(read, "json", "entity", "section", "article", column_meta=True)
        return s.result(found.select("entity", "section", "table_id", F.array_join("columns", "|").alias("columns"), F.size("table_rows").alias("n_rows"), F.size(F.col("column_meta")["Segment"]).alias("n_segments")), "tables")


@query
def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON itself, byte for byte: a link, a quote, a backslash and characters beyond ASCII, with and without escapes."""
    nation = table(spark, sf_dir, "nation").withColumn("article", F.col("n_nationkey"))
    odd = F.concat(F.lit('"'), F.col("n_name"), F.lit('" \\ \u00e9 \U0001f600'))
    row = H.tr(H.td(odd), H.element("td", H.element("a", H.text("see"), title=F.col("n_name"))))
    found = R.tables(extracted(nation, ["n_nationkey"], row, head("Name", "Link")), "article")
    text = J.table_json(J.table_struct(F.col("article"), markup=F.lit("")))
    return found.select("article", text.alias("json"), J.ascii_json(text).alias("ascii"))


@query
def text_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.tables(customer_articles(spark, sf_dir), "article")
    return found.select("article", F.md5(writers.dump()).alias("digest"))


@query
def tsv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels as 8-column lines, loaded as labelled tables."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    flat = F.translate(F.coalesce("text", F.lit("")), "\t\n\r", "   ")
    line = F.concat_ws("\t", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"), F.col("quality").cast("string"), F.concat(F.coalesce("toxic", F.lit(0)).cast("string"), F.lit(".25")), flat, F.lit(" {} "), F.lit(" | "))
    found = readers.labelled_tables(docs.select(line.alias("value")))
    return found.select("entity", "section", "table_id", "label", "label_confidence", F.md5("table_html").alias("digest"), "table_json", "table_markup")


def pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document paired with the next id, as 7-column lines."""
    pairs = table(spark, sf_dir, "labels").select(F.concat_ws("\t", F.lit("a"), F.lit("b"), F.lit("s"), F.lit("t"), F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string"), F.when(F.col("quality") == 1, "equivalent").otherwise("noalignment")).alias("value"))
    return readers.table_pairs(pairs)


@query
def pair_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("table_id"), "lang", "source")
    found = R.pair_tables(pair_lines(spark, sf_dir), docs)
    return found.select("source_table_id", "matching_table_id", "label", F.col("source.lang").alias("source_lang"), F.col("matching.lang").alias("matching_lang"))


# ---- features ----------------------------------------------------------------------------------------------

COLUMNS = ("the", "license", "", "und")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tables: their text is markup and HTML."""
    known = F.array(*[F.lit(c) for c in COLUMNS])
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("table_markup"), F.col("text").alias("table_html"), F.lit("the lines of it").alias("table_caption"), known.alias("columns"))


@query
def line_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.markup_lines(documents(spark, sf_dir), "table_markup", "doc_id").groupBy("doc_id", "bucket").agg(F.count("*").alias("n_lines"))


@query
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.token_coverage(documents(spark, sf_dir), "doc_id")
    return found.select("doc_id", "bucket", F.md5("token").alias("token"), "covered", "uncovered")


@query
def coverage_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.coverage_features(X.token_coverage(documents(spark, sf_dir), "doc_id"), "doc_id")


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents() with line feeds, tabs and backslashes of the markup written as escapes."""
    c = F.col("table_markup")
    for plain, written_ in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(written_))
    return documents(spark, sf_dir).withColumn("table_markup", c)


@query
def line_bucket_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.markup_lines(escaped(spark, sf_dir), "table_markup", "doc_id", decode=True).groupBy("doc_id", "bucket").agg(F.count("*").alias("n_lines"))


@query
def token_coverage_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.token_coverage(escaped(spark, sf_dir), "doc_id", decode=True)
    return found.select("doc_id", "bucket", F.md5("token").alias("token"), "covered", "uncovered")


@query
def clean_markup_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return escaped(spark, sf_dir).select("doc_id", F.md5(T.clean_markup("table_markup", decode=True)).alias("digest"))


@query
def bang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.count_of("text", "!!").alias("n_double"), T.count_of("text", "!").alias("n_single"))


@query
def rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rare_words(table(spark, sf_dir, "documents"), "doc_id", value="text")


@query
def char_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each brand, of four columns of its parts."""
    part = table(spark, sf_dir, "part")
    columns = ("p_name", "p_type", "p_size", "p_partkey")
    each = part.select("p_brand", F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("col_index", "value"))
    histogram = each.groupBy("p_brand", "col_index", "value").agg(F.count("*").alias("count"))
    found = X.char_class_profile(histogram, "p_brand", columns=F.lit(len(columns)))
    return found.select("p_brand", "feature", F.round("value", 9).alias("value"))


@query
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.round(X.jaccard(T.strip_tags("html"), title), 9).alias("jacc"))


@query
def kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return X.kl_divergence(table(spark, sf_dir, "pages"), T.strip_tags("html"), title, "page_id").select("page_id", F.round("kl", 6).alias("kl"))


@query
def clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_markup("text")).alias("digest"))


@query
def feature_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of documents' texts under the headers of extracted tables; some tables have one more column name."""
    mixed = H.td(F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.col("c_nationkey").cast("string")).otherwise(F.col("c_mktsegment")))
    row = H.tr(H.td(F.col("c_custkey")), H.td(F.col("c_name")), mixed)
    headers = R.tables(extracted(customers(spark, sf_dir), ["c_custkey"], row, head("Key", "Name", "Mixed"), parts=("header",)), "article").select("article", "header")
    docs = documents(spark, sf_dir).withColumns({"article": F.expr("doc_id div 40"), "columns": F.expr("if(doc_id % 3 = 0, concat(columns, array('no such token')), columns)")})
    found = X.table_features(docs, "doc_id").unionByName(X.profile_features(docs, headers, "article", "doc_id"))
    return found.select("doc_id", "feature", F.round("value", 6).alias("value"))


@query
def feature_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.feature_map(X.coverage_features(X.token_coverage(documents(spark, sf_dir), "doc_id"), "doc_id"), "doc_id")
    return found.select("doc_id", F.size("features").cast("bigint").alias("n_features"), F.aggregate(F.map_values("features"), F.lit(0.0), lambda s, x: s + x).alias("total"))

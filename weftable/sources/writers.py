"""Sinks: article lines, article JSON lines, error records, and a text dump of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftable.functions import text as T
from weftable.functions.nested_json import ascii_json


def crawl_line(entity: Column | str, html: Column | str) -> Column:
    """entity TAB html on one line: comments stripped, then line feeds written as backslash and n."""
    entity = F.col(entity) if isinstance(entity, str) else entity
    return F.concat_ws("\t", entity, T.escape_newlines(T.strip_comments(html)))


def write_crawl(df: DataFrame, path: str, entity: str = "entity", html: str = "html") -> None:
    df.select(crawl_line(entity, html).alias("value")).write.mode("overwrite").text(path)


def article_struct(articles: DataFrame) -> Column:
    """The published nested record of an extracted article; ids from a map column table_ids where there is one."""
    from weftable.functions.nested_json import table_struct

    def table(s: Column, t: Column) -> Column:
        place = F.concat_ws("-", s["section_ord"].cast("string"), t["table_ord"].cast("string"), t["sub_id"].cast("string"))
        id_ = F.try_element_at(F.col("table_ids"), place) if "table_ids" in articles.columns else F.lit(None)
        return table_struct(id_, t["header"], t["rows"], t["caption"], t["markup"])

    tables = F.transform("sections", lambda s: F.struct(s["section"].alias("section"), F.transform(s["tables"], lambda t: table(s, t)).alias("tables")))
    return F.struct(F.col("entity"), tables.alias("sections"))


def with_article_ids(articles: DataFrame, *key: str) -> DataFrame:
    """Adds table_ids: place of a table in its article -> its dense id."""
    from weftable.operators.relational import tables, with_table_ids

    ids = with_table_ids(tables(articles, *key).select(*key, "section_ord", "table_ord", "sub_id"), *key)
    place = F.concat_ws("-", F.col("section_ord").cast("string"), F.col("table_ord").cast("string"), F.col("sub_id").cast("string"))
    return articles.join(ids.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(place, "table_id"))).alias("table_ids")), list(key), "left")


def article_json(articles: DataFrame, ascii_only: bool = False) -> DataFrame:
    out = articles.select(F.to_json(article_struct(articles)).alias("value"))
    return out.select(ascii_json(F.col("value")).alias("value")) if ascii_only else out


def write_article_json(articles: DataFrame, path: str, ascii_only: bool = False) -> None:
    """One JSON object per article; every article is written, those without tables too."""
    article_json(articles, ascii_only).write.mode("overwrite").text(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """Failed tables, one JSON record each; line feeds are escaped by JSON."""
    errors.write.mode("overwrite").json(path)


def dump(header: Column | str = "header", rows: Column | str = "rows") -> Column:
    """Leaf headers, then rows, tab-separated; cells as `text title=anchor;...`; tables of any size, empty too."""
    header = F.col(header) if isinstance(header, str) else header
    rows = F.col(rows) if isinstance(rows, str) else rows
    names = F.array_join(F.transform(F.try_element_at(header, F.lit(-1))["columns"], lambda c: c["name"]), "\t")
    shown = lambda c: F.concat_ws(" ", c["value"], F.nullif(F.array_join(F.transform(c["structured_values"], lambda x: F.concat(x["structured"], F.lit("="), x["anchor"], F.lit(";"))), ""), F.lit("")))
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r["values"], shown), "\t"))
    return F.array_join(F.concat(F.array(F.coalesce(names, F.lit(""))), F.coalesce(lines, F.array().cast("array<string>"))), "\n")

"""Relational rows rendered as article HTML, as Catalyst expressions: round trips need pages with known tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(value: Column | str) -> Column:
    """A value as HTML text; null is empty. A str is a literal."""
    c = F.lit(value) if isinstance(value, str) else value
    c = F.coalesce(c.cast("string"), F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def element(tag: str, *content: Column, **attrs: Column | str | int) -> Column:
    """`content` is HTML; attribute names may end in "_" where Python reserves them."""
    parts = [F.lit(f"<{tag}")]
    for name, value in attrs.items():
        parts += [F.lit(f' {name.rstrip("_").replace("_", "-")}="'), text(str(value) if isinstance(value, int) else value), F.lit('"')]
    return F.concat(*parts, F.lit(">"), *content, F.lit(f"</{tag}>"))


def td(value: Column | str, **attrs) -> Column:
    return element("td", text(value), **attrs)


def th(value: Column | str, **attrs) -> Column:
    return element("th", text(value), **attrs)


def tr(*cells: Column) -> Column:
    return element("tr", *cells)


def wikitable(*rows: Column, caption: Column | str | None = None) -> Column:
    head = [] if caption is None else [element("caption", text(caption))]
    return element("table", *head, *rows, class_="wikitable")


def section(heading: Column | str | None, *content: Column, level: int = 2, number: int = 1) -> Column:
    head = [] if heading is None else [element(f"h{level}", text(heading))]
    return element("section", *head, *content, data_mw_section_id=number)


def article(title: Column | str, *body: Column) -> Column:
    return element("html", element("head", element("title", text(title))), element("body", *body))


def gathered(df: DataFrame, key: str, order: list[str], html: Column, *more: Column) -> DataFrame:
    """(key, rows, rows1, ...): the HTML of a key's rows in order, one column for each html. Keys must be of bounded
    size, as tables of an article are.

    The rows are dealt by key before they are rendered, to as many partitions as the session has for shuffles: HTML is
    long but compresses so well that Spark would join its partitions into about one a core, whose last one is waited for."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = F.array_sort(F.collect_list(F.struct(*order, *[h.alias(f"_html{i}") for i, h in enumerate((html, *more))])))
    joined = lambda i: F.array_join(F.transform(each, lambda x: x[f"_html{i}"]), "")
    return df.repartition(n, key).groupBy(key).agg(*[joined(i).alias(f"rows{i or ''}") for i in range(1 + len(more))])

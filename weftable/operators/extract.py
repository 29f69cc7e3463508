"""From the HTML of an article to its sections, tables, sub-tables, headers and cell grids.

extract_article() is plain Python on one page; extract() applies it to a DataFrame in one Arrow stage, the only
opaque stage of the engine. A table that can't be laid out becomes an error record and never fails the task;
sub-tables that were laid out before it stay.

mode="reference" keeps the visible behaviour of the established extractor: a divider row replaces the last
inherited header row, a first data row without headers is header and data, a cell's column is looked up before
occupied slots are skipped, and a span of 0 covers nothing. mode="corrected" inherits all header rows, uses a
substitute header row once, names a cell's column by where it lands, and lets a row span of 0 reach the last row.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftable import schemas
from weftable.operators.dom import Element, parse, title

_INTEGER = re.compile(r"[+-]?[0-9]+")


class LayoutError(Exception):
    """A table whose rows, headers and spans don't make a grid."""


def span(e: Element, name: str) -> int:
    if not e.attrs or name not in e.attrs:
        return 1
    v = e.attrs[name]
    if not _INTEGER.fullmatch(v) or not -(2**31) <= int(v) < 2**31:
        raise LayoutError(f"{name} is no integer: {v[:40]!r}")
    return int(v)


def section_name(section: Element) -> str:
    if section.attrs.get("data-mw-section-id", "") == "0":
        return "MAIN_SECTION"
    for tag in ("h2", "h3", "h4", "h5"):
        found = section.select(tag)
        if found:
            return found[0].text()
    return ""


def sub_tables(table: Element, mode: str = "reference") -> list[list[Element]]:
    """Rows of each sub-table: header-only rows that follow data begin a new one, which inherits headers."""
    subs: list[list[Element]] = []
    in_data = False
    for row in table.select("tr"):
        if not subs:
            subs.append([])
        th, td = row.has("th"), row.has("td")
        if td:
            in_data = True
        elif not th:
            continue
        elif in_data:
            in_data = False
            first = subs[0]
            if mode == "corrected":
                subs.append([r for r in first if not r.has("td")] or first[:1])
                continue  # the divider names the part and heads no column
            else:
                top = [r for r in first if r.has("th")] if len(first) > 1 else first
                if not top:
                    raise LayoutError("a divider row without a header row to inherit")
                subs.append(top[:-1])
        subs[-1].append(row)
    return subs


class _Grid:
    """A matrix that headers or cells are placed in, row by row."""

    def __init__(self, rows: int, columns: int) -> None:
        self.slots: list[list] = [[None] * columns for _ in range(rows)]
        self.columns = columns

    def free(self, row: int, at: int) -> int:
        """The next free slot at or after `at`, else `at` itself."""
        line = self.slots[row]
        if at >= len(line):
            raise LayoutError("more cells than columns")
        return next((j for j in range(at, len(line)) if line[j] is None), at)

    def place(self, item: object, row: int, at: int, col_span: int, row_span: int) -> int:
        """Fills the item's slots, cut at the edges; gives where to go on."""
        k = self.free(row, at)
        if col_span == row_span == 1 and k < self.columns:
            self.slots[row][k] = item
            return k + 1
        rows = range(row, min(row + row_span, len(self.slots)))
        for i in rows:
            for j in range(k, min(k + col_span, self.columns)):
                self.slots[i][j] = item
        return k + col_span


#: What a table is made of; extract() may be asked for some of it.
PARTS = ("markup", "header", "rows")


def lay_out(rows: list[Element], mode: str = "reference", parts: tuple[str, ...] = PARTS) -> dict:
    """Header levels and cell rows of one sub-table."""
    corrected = mode == "corrected"
    data: list[Element] = []
    head: list[Element] = []
    for r in rows:
        (data if r.has("td") else head).append(r)
    tags: tuple[str, ...] = ("th",)
    if not head:
        if not data:
            raise LayoutError("rows without cells")
        head, tags = data[:1], ("td", "th") if corrected else ("td",)
        if corrected:
            data = data[1:]
    headers: list[dict] = []
    grid = None
    for i, r in enumerate(head):
        cells = r.select(*tags)
        if i == 0:
            width = sum(max(1, span(c, "colspan")) if corrected else span(c, "colspan") for c in cells)
            if width < 0:
                raise LayoutError("negative width")
            grid = _Grid(len(head), width)
        k = 0
        for c in cells:
            wide, high = span(c, "colspan"), span(c, "rowspan")
            if corrected:
                wide, high = max(1, wide), high if high > 0 else len(head)
            h = {"uid": len(headers), "name": c.text(), "col_span": wide, "row_span": high, "dist": Counter()}
            headers.append(h)
            k = grid.place(h, i, k, wide, high)
    leaf = grid.slots[-1]
    shown: set[int] = set()

    def is_first(cell: dict) -> bool:
        new = cell["uid"] not in shown
        shown.add(cell["uid"])
        return new

    body = _Grid(len(data), len(leaf))
    uid = 0
    for i, r in enumerate(data):
        k = 0
        for e in r.walk()[1:]:
            if e.tag not in ("td", "th") and not e.has("td", "th"):
                continue
            if k >= len(leaf):
                raise LayoutError("more cells than columns")
            wide, high = span(e, "colspan"), span(e, "rowspan")
            if corrected:
                wide, high = max(1, wide), high if high > 0 else len(data)
                header = leaf[body.free(i, k)]
            else:
                header = leaf[k]
            cell = {"uid": uid, "header": header, "value": e.text(), "links": [(a.attrs.get("title", ""), a.text()) for a in e.select("a")]}
            uid += 1
            k = body.place(cell, i, k, wide, high)
            if header is None:
                raise LayoutError("a cell under no header")
            header["dist"].update([t for t, _ in cell["links"]] or [cell["value"]])
    return {
        "num_columns": len(leaf),
        "header": None if "header" not in parts else [{"level": n, "columns": [{"header_uid": h["uid"], "col_index": j, "name": h["name"], "col_span": h["col_span"], "row_span": h["row_span"], "value_dist": _sorted(h["dist"])} for j, h in enumerate(line) if h is not None]} for n, line in enumerate(grid.slots)],
        "rows": None if "rows" not in parts else [
            {
                "row_index": n,
                "values": [
                    {"cell_uid": c["uid"], "is_first": is_first(c), "header_uid": c["header"]["uid"], "column": c["header"]["name"], "column_at_index": leaf[j]["name"] if leaf[j] else None, "col_index": j, "value": c["value"], "structured_values": [{"structured": s, "anchor": a} for s, a in c["links"]] or None}
                    for j, c in enumerate(line) if c is not None
                ],
            }
            for n, line in enumerate(body.slots)
        ],
    }


def _sorted(dist: Counter) -> list[dict]:
    return [{"value": v, "count": n} for v, n in sorted(dist.items(), key=lambda x: (-x[1], x[0]))]


def extract_article(html: str, mode: str = "reference", dedupe: bool = False, parts: tuple[str, ...] = PARTS) -> dict:
    """entity, sections (with tables) and errors of a page.

    dedupe: a table in nested sections comes once, under the innermost, instead of under each.
    parts: what is made of each table; all tables are laid out whole, and what isn't asked for is null.
    """
    root = parse(html)
    out: dict = {"entity": title(root).replace(" ", "_"), "sections": [], "errors": []}
    for n, section in enumerate(root.select("section")):
        name, tables = section_name(section), section.by_class("wikitable")
        if dedupe:
            tables = [t for t in tables if _innermost(t) is section]
        if not name or not tables:
            continue
        found: list[dict] = []
        for m, table in enumerate(tables):
            if len(table.select("table")) > 1:
                continue
            markup, caption = table.html() if "markup" in parts else None, " ".join(c.text() for c in table.select("caption")).strip()
            try:
                for sub, rows in enumerate(sub_tables(table, mode)):
                    found.append({"table_ord": m, "sub_id": sub, "caption": caption, "markup": markup, **lay_out(rows, mode, parts)})
            except LayoutError as e:
                out["errors"].append({"section_ord": n, "section": name, "table_ord": m, "reason": str(e), "html": table.html()})
        out["sections"].append({"section_ord": n, "section": name, "tables": found})
    return out


def _innermost(e: Element) -> Element | None:
    while e is not None and e.tag != "section":
        e = e.parent
    return e


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def extract(pages: DataFrame, html_col: str = "html", mode: str = "reference", dedupe: bool = False, unescape_newlines: bool = False, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """pages with entity, sections and errors. All other columns come along; null html is an empty page. Of the tables,
    the parts that aren't named are null: who reads cells alone need not have markup and headers made."""
    keep = [c for c in pages.columns if c != html_col]
    slim = pages.select(F.col(f"`{html_col}`").cast("string").alias("html"), F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("page"))
    arrow = _arrow_schema(schemas.EXTRACTED)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # rows are whole pages
                part = batch.slice(i, 64)
                rows = []
                for h in part.column("html").to_pylist():
                    h = h or ""
                    rows.append(extract_article(h.replace("\\n", "\n") if unescape_newlines else h, mode, dedupe, parts))
                made = pa.RecordBatch.from_pylist(rows, schema=arrow)
                yield pa.RecordBatch.from_arrays([part.column("page"), *made.columns], names=["page", *arrow.names])

    schema = StructType([slim.schema["page"], *StructType.fromDDL(schemas.EXTRACTED)])
    return slim.mapInArrow(run, schema).select(*[F.col("page").getField(c).alias(c) for c in keep], *arrow.names)


def page_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A row per link of each page, in or out of tables: pos, structured (its title, or empty) and anchor (its text)."""
    keep = [c for c in pages.columns if c != html_col]
    slim = pages.select(F.col(f"`{html_col}`").cast("string").alias("html"), F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("page"))
    kind = f"array<{schemas.LINK}>"
    arrow = _arrow_schema(f"links {kind}")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [{"links": [{"structured": a.attrs.get("title", ""), "anchor": a.text()} for a in parse(h or "").select("a")]} for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page"), *pa.RecordBatch.from_pylist(rows, schema=arrow).columns], names=["page", "links"])

    schema = StructType([slim.schema["page"], *StructType.fromDDL(f"links {kind}")])
    found = slim.mapInArrow(run, schema).select(*[F.col("page").getField(c).alias(c) for c in keep], F.posexplode("links").alias("pos", "l"))
    return found.select(*keep, "pos", "l.structured", "l.anchor")

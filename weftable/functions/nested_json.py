"""Nested tables as JSON text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftable import schemas


def table_struct(table_id: Column, header: Column | str = "header", rows: Column | str = "rows", caption: Column | str = "caption", markup: Column | str = "markup") -> Column:
    """The published form of an extracted table: empty slots and identities left out, no empty link lists."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    levels = F.transform(as_col(header), lambda h: F.struct(h["level"].alias("level"), F.transform(h["columns"], lambda c: F.struct(c["name"].alias("name"), c["col_span"].alias("col_span"), c["row_span"].alias("row_span"), c["value_dist"].alias("value_dist"))).alias("columns")))
    linked = lambda c: F.when(F.size(c["structured_values"]) > 0, c["structured_values"])
    lines = F.transform(as_col(rows), lambda r: F.struct(r["row_index"].alias("row_index"), F.transform(r["values"], lambda c: F.struct(c["column"].alias("column"), c["col_index"].alias("col_index"), c["value"].alias("value"), linked(c).alias("structured_values"))).alias("values")))
    return F.struct(as_col(caption).alias("caption"), as_col(markup).alias("markup"), table_id.cast("int").alias("id"), levels.alias("header"), lines.alias("rows"))


def table_json(table: Column) -> Column:
    """JSON text of a table; fields that are null are left out."""
    return F.to_json(table, {"ignoreNullFields": "true"})


def ascii_json(json: Column) -> Column:
    """The same JSON with everything beyond ASCII as \\uXXXX escapes; JVM-side, by UTF-16 units."""
    units = F.transform(F.split(json, ""), lambda ch: F.when(ch.rlike("[^\\x00-\\x7F]"), _escaped(ch)).otherwise(ch))
    return F.array_join(units, "")


def _escaped(ch: Column) -> Column:
    utf16 = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    return F.regexp_replace(utf16, "(.{4})", "\\\\u$1")


def load_table(json: Column | str, counts: bool = True, values: bool = True, mode: str = "reference") -> Column:
    """A table from JSON text, with or without histograms and cells; what isn't asked for isn't parsed.

    reference mode keeps of a cell what readers of the published form keep: its column and value; corrected mode
    keeps its index and links too. Broken JSON gives null fields.
    """
    json = F.col(json) if isinstance(json, str) else json
    if not values:
        kind = schemas.TABLE_HEADERS_ONLY if counts else schemas.TABLE_NAMES_ONLY
    else:
        kind = schemas.TABLE if mode == "corrected" else schemas.TABLE_CELLS
        if not counts:
            kind = kind.replace(f",value_dist:array<{schemas.VALUE_COUNT}>", "")
    return F.from_json(json, kind)


def resolved_rows(table: Column) -> Column:
    """Rows of a loaded table with each cell's column looked up by name: the first leaf of that name; cells of
    unknown columns are null, and a cell's place is its place in the list."""
    leaf = F.try_element_at(table["header"], F.lit(-1))["columns"]
    names = F.transform(leaf, lambda c: c["name"])

    def cell(c: Column, i: Column) -> Column:
        at = F.array_position(names, c["column"]).cast("int") - 1
        return F.when(at >= 0, F.struct(i.alias("slot"), at.alias("col_index"), c["column"].alias("column"), c["value"].alias("value")))

    return F.transform(table["rows"], lambda r: F.struct(r["row_index"].alias("row_index"), F.transform(r["values"], cell).alias("values")))

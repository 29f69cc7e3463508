"""Relational forms of extracted articles, and the operations on them; all of it Catalyst expressions.

extract() gives a nested row per article. The functions here unnest it to sections, tables, headers, cells and
links, build histograms, look columns up, and nest tables again. Articles are told apart by the key columns
that the caller names (any columns of the input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftable.sources.shared import written

TABLE_ID_BASE = 5_000_000


def sections(articles: DataFrame, *key: str) -> DataFrame:
    """A row per kept section; sections without a laid-out table stay, with no tables."""
    return articles.select(*key, "entity", F.explode("sections").alias("s")).select(*key, "entity", "s.section_ord", "s.section", "s.tables")


def tables(articles: DataFrame, *key: str) -> DataFrame:
    """A row per sub-table."""
    return sections(articles, *key).select(*key, "entity", "section_ord", "section", F.explode("tables").alias("t")).select(*key, "entity", "section_ord", "section", "t.*")


def errors(articles: DataFrame, *key: str) -> DataFrame:
    """A row per table that could not be laid out."""
    return articles.select(*key, "entity", F.explode("errors").alias("e")).select(*key, "entity", "e.*")


def with_table_ids(tables_: DataFrame, *key: str, base: int = TABLE_ID_BASE) -> DataFrame:
    """Dense ids base + 1, base + 2, ... in the order of key, section, table and sub-table.

    Rows are range-partitioned by that order; only counts per partition meet, so no task sees all rows. Ids are
    bigint; the published JSON has int, and writing it fails beyond that rather than wrap around.
    """
    order = [*key, "section_ord", "table_ord", "sub_id"]
    spark = tables_.sparkSession
    dealt = tables_.repartitionByRange(*order).sortWithinPartitions(*order)
    at = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    at = at.withColumn("_nth", F.col("_at") - F.col("_part").cast("bigint") * F.lit(1 << 33))
    counts = at.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    # as many rows as there are partitions: bounded, so it may be broadcast
    return at.join(F.broadcast(before), "_part").withColumn("table_id", F.lit(base + 1).cast("bigint") + F.col("_before") + F.col("_nth")).drop("_part", "_at", "_nth", "_before")


def stable_table_id(*key: str) -> Column:
    """An id that needs no order among tables, for corpora where dense ids aren't worth a shuffle."""
    return F.xxhash64(*key, "section_ord", "table_ord", "sub_id")


#: What tells the sub-tables of an article apart; uids of headers and cells count from 0 in each.
PLACE = ("section_ord", "table_ord", "sub_id")


def placed(key: tuple[str, ...]) -> list[str]:
    """The caller's key columns and the place of a sub-table in its article."""
    return [*key, *(p for p in PLACE if p not in key)]


def headers(tables_: DataFrame, *key: str) -> DataFrame:
    """A row per filled header slot: key, place of the sub-table, level, slot and header."""
    at = placed(key)
    each = tables_.select(*at, F.explode("header").alias("h"))
    return each.select(*at, F.col("h.level").alias("level"), F.explode("h.columns").alias("c")).select(*at, "level", "c.col_index", "c.header_uid", "c.name", "c.col_span", "c.row_span")


def leaf_headers(tables_: DataFrame, *key: str) -> DataFrame:
    at = placed(key)
    leaf = F.element_at("header", -1)["columns"]
    return tables_.filter(F.size("header") > 0).select(*at, F.explode(leaf).alias("c")).select(*at, "c.col_index", "c.header_uid", "c.name")


def cells(tables_: DataFrame, *key: str) -> DataFrame:
    """A row per filled cell slot: key, place of the sub-table, row_index and the cell. A cell that spans several slots
    has one cell_uid, and is_first in one of them."""
    at = placed(key)
    rows = tables_.select(*at, F.explode("rows").alias("r"))
    return rows.select(*at, F.col("r.row_index").alias("row_index"), F.explode("r.values").alias("c")).select(*at, "row_index", "c.*")


def links(cells_: DataFrame, *key: str) -> DataFrame:
    """A row per link of each cell (once, however many slots it spans)."""
    at = [*placed(key), "cell_uid"]
    return cells_.filter("is_first").select(*at, F.posexplode("structured_values").alias("pos", "l")).select(*at, "pos", "l.structured", "l.anchor")


def value_histogram(cells_: DataFrame, *key: str) -> DataFrame:
    """(key, place, header_uid, column, value, count): link titles of cells with links, else the cell's text; each
    cell once. column is the header's name."""
    values = F.when(F.size("structured_values") > 0, F.transform("structured_values", lambda x: x["structured"])).otherwise(F.array("value"))
    by = [*placed(key), "header_uid", "column"]
    return cells_.filter("is_first").select(*by, F.explode(values).alias("value")).groupBy(*by, "value").agg(F.count("*").cast("int").alias("count"))


def sorted_domain(histogram: DataFrame, *key: str) -> DataFrame:
    """Values of each column with their rank by count, descending, then by value."""
    order = Window.partitionBy(*key).orderBy(F.desc("count"), F.asc("value"))
    return histogram.withColumn("rank", F.row_number().over(order))


def histograms(tables_: DataFrame, *key: str) -> DataFrame:
    """Value counts as the extractor put them beside each leaf header, for leaf slots."""
    at = placed(key)
    leaf = F.element_at("header", -1)["columns"]
    return tables_.filter(F.size("header") > 0).select(*at, F.explode(leaf).alias("c")).select(*at, "c.col_index", "c.name", F.explode("c.value_dist").alias("v")).select(*at, "col_index", "name", "v.value", "v.count")


def find_column(headers_: DataFrame, name: str, *key: str) -> DataFrame:
    """The first leaf column of a name in each sub-table; those without it give no row."""
    return headers_.filter(F.col("name") == name).groupBy(*placed(key)).agg(F.min("col_index").alias("col_index"))


def find_column_index(header: Column | str, name: str) -> Column:
    """The same inside a nested row: a leaf column's index, or null."""
    leaf = F.try_element_at(header if isinstance(header, Column) else F.col(header), F.lit(-1))["columns"]
    return F.try_element_at(F.filter(leaf, lambda c: c["name"] == name), F.lit(1))["col_index"]


def num_columns(tables_: DataFrame) -> DataFrame:
    return tables_.withColumn("num_columns", F.coalesce("num_columns", F.lit(0)))


def segments(rows: DataFrame, is_header: Column, is_data: Column, partition: list[str], order: list[str], spread: bool = False) -> DataFrame:
    """Sub-table numbers of rows: one more at each header-only row that follows a data row.

    Rows that are neither are dropped. Works over rows of any source, as a window of gaps and islands. spread: a key
    may be of any size; its rows are cut into ranges of the order, and numbers are carried from range to range."""
    kept = rows.withColumns({"_d": is_data, "_h": is_header}).filter("_d or _h").drop("_h")
    if spread:
        return _spread_segments(kept, partition, order)
    w = Window.partitionBy(*partition).orderBy(*order)
    begins = (~F.col("_d") & F.coalesce(F.lag("_d").over(w), F.lit(False))).cast("int")
    return kept.withColumn("_b", begins).withColumn("sub_id", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_d", "_b")


def _spread_segments(kept: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    # ranges must be the same wherever they are read, so they are a table
    ranges = written(kept.repartitionByRange(*partition, *order).withColumn("_range", F.spark_partition_id()), "segment-ranges")
    w = Window.partitionBy("_range", *partition).orderBy(*order)
    begins = (~F.col("_d") & F.coalesce(F.lag("_d").over(w), F.lit(False))).cast("int")
    inside = ranges.withColumn("_b", begins).withColumn("_n", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each range of a key: what it begins and ends with, and how many numbers it takes
    at = F.struct(*order)
    edges = inside.groupBy("_range", *partition).agg(F.min_by("_d", at).alias("_first"), F.max_by("_d", at).alias("_last"), F.max("_n").alias("_all"))
    along = Window.partitionBy(*partition).orderBy("_range")
    joint = (~F.col("_first") & F.coalesce(F.lag("_last").over(along), F.lit(False))).cast("int")
    carried = edges.withColumn("_joint", joint).withColumn("_before", F.sum(F.col("_joint") + F.col("_all")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_all"))
    carried = carried.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(partition)], "_before")
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(carried, same).withColumn("sub_id", (F.col("_n") + F.col("_before")).cast("int")).select(*[c for c in kept.columns if c != "_d"], "sub_id")


def segments_of(flags: Column) -> Column:
    """The same for an array of is-data flags inside one row, without a shuffle."""
    start = F.struct(F.lit(0).alias("id"), F.lit(False).alias("d"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, d: Column) -> Column:
        n = s["id"] + (s["d"] & ~d).cast("int")
        return F.struct(n.alias("id"), d.alias("d"), F.concat(s["out"], F.array(n)).alias("out"))

    return F.aggregate(flags, start, step, lambda s: s["out"])


def row_dicts(tables_: DataFrame, *key: str) -> DataFrame:
    """(key, place, row_index, row): column -> value of each row; of columns with one name the last counts."""
    at = placed(key)
    each = tables_.select(*at, F.explode("rows").alias("r"))
    names = F.array_distinct(F.transform("r.values", lambda c: c["column"]))
    last = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter("r.values", lambda c: c["column"].eqNullSafe(n)), -1)["value"].alias("value")))
    return each.select(*at, F.col("r.row_index").alias("row_index"), F.map_from_entries(last).alias("row"))


def ordered_columns(rows: Column | str = "rows") -> Column:
    """Distinct column names in the order in which rows first show them."""
    rows = F.col(rows) if isinstance(rows, str) else rows
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(r["values"], lambda c: c["column"]))))


def column_meta(header: Column | str = "header") -> Column:
    """Leaf column name -> its values, without counts; of columns with one name the last counts."""
    header = F.col(header) if isinstance(header, str) else header
    leaf = F.try_element_at(header, F.lit(-1))["columns"]
    names = F.array_distinct(F.transform(leaf, lambda c: c["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.transform(F.element_at(F.filter(leaf, lambda c: c["name"].eqNullSafe(n)), -1)["value_dist"], lambda v: v["value"]).alias("value"))))


def pair_tables(pairs: DataFrame, tables_: DataFrame, id_col: str = "table_id") -> DataFrame:
    """Both tables of each labelled pair, joined by table id; a pair with an unknown table stays, with nulls."""
    side = lambda name: F.struct(*[F.col(c) for c in tables_.columns]).alias(name)
    a = tables_.select(F.col(id_col).alias("source_table_id"), side("source"))
    b = tables_.select(F.col(id_col).alias("matching_table_id"), side("matching"))
    return pairs.join(a, "source_table_id", "left").join(b, "matching_table_id", "left")

"""Sources: seed lists, article lines, nested JSON articles, labelled tables and table pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftable import schemas
from weftable.functions import text as T
from weftable.functions.nested_json import load_table


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """entity: the distinct lines of a seed list; empty lines are no seeds."""
    return distinct_seeds(spark.read.text(path), "value")


def distinct_seeds(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("entity")).filter("entity is not null and entity <> ''").distinct()


def article_lines(lines: DataFrame) -> DataFrame:
    """source_entity, html of lines `entity TAB html`; a line without a tab is html alone. Batch or streaming."""
    tab = F.instr("value", "\t")
    return lines.select(F.when(tab > 0, F.left("value", tab - 1)).alias("source_entity"), T.payload("value").alias("html"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return article_lines(spark.read.text(path))


def read_article_json(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Articles from JSON lines, by the published schema (no inference pass).

    gzip files can't be split: `partitions` deals the articles out before what follows."""
    df = spark.read.schema(StructType.fromDDL(schemas.ARTICLE[len("struct<") : -1])).json(path)
    return df.repartition(partitions) if partitions else df


def labelled_tables(lines: DataFrame, column_meta: bool = False) -> DataFrame:
    """Labelled tables of 8-column TSV lines, with rows (array of maps), columns, header and, on request,
    column_meta. Short lines and numbers that aren't numbers give nulls."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    df = lines.select(
        at(0).alias("entity"), at(1).alias("section"), T.integer(at(2)).alias("table_id"), at(3).alias("label"), at(4).try_cast("double").alias("label_confidence"),
        T.strip(at(5)).alias("table_html"), T.strip(at(6)).alias("table_json"), T.strip(at(7)).alias("table_markup"),
    )
    return parsed_tables(df, column_meta)


def parsed_tables(df: DataFrame, column_meta: bool = False) -> DataFrame:
    """Adds what the JSON of a table says: table_caption, header, rows, columns."""
    from weftable.operators.relational import column_meta as meta
    from weftable.operators.relational import ordered_columns

    df = df.withColumn("_t", load_table("table_json"))
    last = lambda r: F.map_from_entries(F.transform(F.array_distinct(F.transform(r["values"], lambda c: c["column"])), lambda n: F.struct(n.alias("key"), F.element_at(F.filter(r["values"], lambda c: c["column"].eqNullSafe(n)), -1)["value"].alias("value"))))
    df = df.withColumns({"table_caption": F.col("_t.caption"), "header": F.col("_t.header"), "table_rows": F.transform("_t.rows", last), "columns": ordered_columns(F.col("_t.rows"))})
    if column_meta:
        df = df.withColumn("column_meta", meta("header"))
    return df.drop("_t")


def table_json(df: DataFrame, json_col: str, entity: str, section: str, table_id: str, column_meta: bool = False) -> DataFrame:
    """Tables from a column of JSON and columns of metadata; label, HTML and markup are not set."""
    slim = df.select(F.col(entity).alias("entity"), F.col(section).alias("section"), F.col(table_id).alias("table_id"), F.col(json_col).alias("table_json"))
    return parsed_tables(slim, column_meta)


def table_pairs(lines: DataFrame) -> DataFrame:
    """Labelled pairs of tables from 7-column TSV lines."""
    f = F.split("value", "\t")
    kinds = StructType.fromDDL(schemas.TABLE_PAIR)
    cells = [T.integer(F.get(f, F.lit(i))) if k.dataType.simpleString() == "int" else F.get(f, F.lit(i)) for i, k in enumerate(kinds)]
    return lines.select(*[c.alias(k.name) for c, k in zip(cells, kinds)])


def read_labelled_tables(spark: SparkSession, path: str, column_meta: bool = False) -> DataFrame:
    return labelled_tables(spark.read.text(path), column_meta)


def read_table_pairs(spark: SparkSession, path: str) -> DataFrame:
    return table_pairs(spark.read.text(path))

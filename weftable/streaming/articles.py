"""Article lines as a stream: the same extraction on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftable.operators.extract import extract
from weftable.sources.readers import article_lines
from weftable.sources.writers import article_json


def stream_articles(spark: SparkSession, path: str, mode: str = "reference", files_per_trigger: int = 16) -> DataFrame:
    """Extracted articles of text files that land in path."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return extract(article_lines(lines), "html", mode)


def stream_to_json(articles: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends JSON lines; with available_now it ends when what is there has been read."""
    writer = article_json(articles).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()

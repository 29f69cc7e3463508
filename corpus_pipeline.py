"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. run() writes each stage's result as Parquet in the shared folder and reads it again; at the end
only the last one is left there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftable.llm import byte_bpe, decontaminate, lang_id, line_dedup, near_dup
from weftable.llm.common import scratch, written

#: Words of a shingle in the near-dedup stage.
SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null, empty and letterless texts go; a null lang or doc_id is only not learnt from; repeated rows stay or go
    together; no row gives no row; other columns come along, whatever their names."""
    model = lang_id.train(docs, ~lang_id.held_out())
    return lang_id.identified(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents or more have; n_chars follows the text.

    Every row stays, whatever its doc_id: null texts stay null, a text may become empty; repeated rows count as documents
    of their own; a line that exactly ten rows have goes; no row gives no row; other columns come along."""
    return line_dedup.without_lines(docs, threshold=10, min_chars=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id.

    Texts that are null or have no words are in no group. Rows of one doc_id and one text are one document, of which
    one row stays, as are rows without a doc_id that share a text; rows of one doc_id and different texts stay or go
    together. No row gives no row; other columns come along."""
    found = near_dup.groups(docs, shingle=SHINGLE)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")
    left = docs.join(written(gone, "near-duplicates"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    again = written(left.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("id")), "repeated-ids")
    if not again.limit(1).count():
        return left
    a, b = left.alias("a"), again.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.id"))
    row = F.struct(*[F.col(f"a.`{c}`") for c in docs.columns])
    one = a.join(b, same, "left_semi").groupBy(F.col("a.doc_id").alias("k"), F.md5("a.text").alias("m")).agg(F.first(row).alias("r"))
    return a.join(b, same, "left_anti").unionByName(one.select(*[F.col("r").getField(c).alias(c) for c in docs.columns]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: ten words in a row of an item, or all of a shorter one.

    Null, empty and wordless texts stay, whatever their doc_id, as does everything where the benchmark is empty; repeated
    rows stay or go together; other columns come along."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left.

    A null text is an empty one: no ids, and the digests of nothing. Every row gives a row, so repeated rows and null
    doc_ids do; other columns are ignored."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: Learnt classifiers and components by iteration have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as whole:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as own:
                docs = own.result(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return whole.result(stage(spark, docs, sf_dir), name)

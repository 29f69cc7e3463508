from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and very long texts, repeated rows, and columns whose names clash with those of results."""
    rng = random.Random(5)
    long_ = " ".join(rng.choice(["alpha", "beta", "é", "12", "gamma-delta"]) for _ in range(60_000)) + "\n" + "x" * 50_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long_), (5, long_), (6, "!!! ... ??"), (7, "A b c d e\nf"), (7, "A b c d e\nf"), (None, "A b c d e\nf"), (8, "\n\n"), (9, "0" * 3000), (10, "é 😀   z")]
    schema = "doc_id bigint, text string, lang string, kept string, n_lines int, score double, lang_pred string, component_id int, spans int, row int, n_chars bigint"
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "k", 1, 0.5, "p", 3, 4, 5, len(t or "")) for i, t in rows], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

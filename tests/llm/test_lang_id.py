from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from weftable.llm import lang_id as L


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in L.report(df).collect()}
    assert len(got) == df.count()
    right = total = 0
    for r in df.select("doc_id", "text", "lang").collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= g["score"] <= 1
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (g["lang_pred"] == "und") == (not letters)
        if g["held_out"] and r["lang"] and letters:
            total += 1
            right += g["lang_pred"] == r["lang"]
    assert total > 100 and right / total > 0.93, (right, total)


def test_held_out_rows_are_never_learnt_from(spark):
    """Their labels and texts may be anything."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = df.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    score = lambda d: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in L.report(d).collect())
    assert score(df) == score(other)


def test_odd_rows(spark, odd, empty):
    got = L.report(odd).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 6, 8, 9}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert L.report(empty).count() == 0
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.report(none).collect()} == {"und"}
    kept = L.identified(odd, L.train(odd, ~L.held_out()))
    assert kept.columns == odd.columns and kept.count() == 6
    out = L.classify(odd, L.train(odd, ~L.held_out()))
    assert len(out.columns) == len(set(out.columns)) == len(odd.columns)


def test_pieces_add_up(monkeypatch):
    text = "Der schnelle braune Fuchs é ü 123 " * 50
    whole = L.features(text)
    monkeypatch.setattr(L, "PIECE", 64)
    assert np.allclose(whole, L.features(text))
    assert np.isclose((whole**2).sum(), 1)


def test_hierarchy():
    rng = np.random.default_rng(1)
    langs = ["en", "de", "fr", "es", "zz"]
    x = np.zeros((250, L.BINS), np.float32)
    y = [langs[i % 5] for i in range(250)]
    for i, lang in enumerate(y):
        x[i, langs.index(lang) * 10 + rng.integers(0, 10, 4)] = 0.5
    m = L.Model.fit(x, y, L.FAMILIES)
    assert m.families == {"germanic": ["de", "en"], "other": ["zz"], "romance": ["es", "fr"]}
    assert {k for k in m.machines if k[0] == "pair"} == {("pair", "de", "en"), ("pair", "es", "fr")}
    got, score = m.predict(x)
    assert np.mean([a == b for a, b in zip(got, y)]) > 0.95 and (score > 0.5).mean() > 0.9

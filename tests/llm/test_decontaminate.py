from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftable.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    sizes = {len(x) for x in windows}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i : i + n]))
                if names:
                    found |= names
                    hit |= set(range(i, i + n))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force_on_the_tables(spark, docs, texts):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute(texts, [(r["item_id"], r["text"]) for r in bench.collect()])
    assert sum(r[5] for r in want) > 0
    assert rows(D.report(docs, bench)) == want
    kept = {r["doc_id"] for r in D.clean(docs, bench).collect()}
    assert kept == {r[0] for r in want if not r[5]}


def test_a_full_sieve_gives_the_same(spark, docs, monkeypatch):
    """With as few bits as let nearly every window through, the join alone must decide."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want, kept = rows(D.report(docs, bench)), rows(D.clean(docs, bench))
    monkeypatch.setattr(D, "SIEVE_BITS", 1 << 10)
    assert rows(D.report(docs, bench)) == want and rows(D.clean(docs, bench)) == kept


def test_documents_are_read_once_and_the_benchmark_stays_off_the_driver(spark, docs):
    """Hashes of a large benchmark become a bitmap; what is broadcast has a bound."""
    bench = spark.range(20_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{j}x"), F.col("id")) for j in range(12)]).alias("text"))
    table = D.windows(D.key_and_text(bench, "item_id", "text"))
    made = D.sieve(table)
    assert made.sizes == [10] and made.bits.nbytes <= D.SIEVE_BITS // 8
    words = [f"w{j}x77".encode() for j in range(12)]
    assert sorted(made.candidates([b"a", *words, b"b"]).values()) == [[1], [2], [3]]
    assert sum(len(made.candidates([b"q%d" % (50 * i + j) for j in range(50)])) for i in range(50)) < 60  # of 2,050
    one = spark.createDataFrame([(1, " ".join(w.decode() for w in words))], "doc_id long, text string")
    assert D.report(one, bench).select("n_hit", "n_items").first()[:] == (12, 1)


def test_small_vocabulary(spark):
    """Few words, so that windows overlap, repeat and tie."""
    rng = random.Random(1)
    make = lambda n: " ".join(rng.choice("abAB") for _ in range(n))
    docs = [(i, make(rng.randint(0, 200))) for i in range(60)]
    items = [(i, make(rng.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(1000, 1012)] + [(7, None), (None, "b b b b a a"), (1000, "x " * 30)]
    docs += [(100, "x " * 500), (101, None)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [("null" if i is None else i, t) for i, t in items])
    assert rows(D.report(a, b)) == want


def test_odd_rows_and_empty_tables(spark, odd, empty, docs):
    bench = spark.createDataFrame([(1, "a B c d e f"), (1, "a b c d e f"), (2, None), (3, "...")], "item_id long, text string")
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert rows(D.report(odd, bench)) == want
    clean = D.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - sum(r[5] for r in want)
    assert D.report(empty, bench).count() == 0 and D.clean(empty, bench).count() == 0
    assert D.clean(odd, bench.limit(0)).count() == odd.count()
    assert not any(r["contaminated"] for r in D.report(odd, bench.limit(0)).collect())


@given(st.lists(st.integers(0, 3), min_size=10, max_size=80), st.integers(0, 70))
@settings(max_examples=200, deadline=None)
def test_a_shared_span_shares_a_fingerprint(items, at):
    h = np.array(items, np.uint64) * np.uint64(7919)
    at = min(at, len(h) - D.WINDOW)
    whole = set(D.fingerprints(h)[1].tolist())
    assert whole & set(D.fingerprints(h[at : at + D.WINDOW])[1].tolist())

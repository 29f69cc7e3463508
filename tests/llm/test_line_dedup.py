from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftable.llm import line_dedup as L


def key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\v\f\r"))


def brute(rows, threshold=10, min_chars=1):
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    count = Counter(k for _, ls in lines for k in {key(x) for x in ls} if len(k) >= min_chars)
    out = []
    for i, ls in lines:
        kept = [x for x in ls if count[key(x)] < threshold]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_the_tables(docs, texts):
    want = brute(texts)
    assert sum(r[2] for r in want) > 0
    assert rows(L.report(docs)) == want


def test_odd_rows(odd, empty):
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for threshold, chars in ((2, 1), (3, 0), (2, 6)):
        assert rows(L.report(odd, threshold, chars)) == brute(plain, threshold, chars)
    assert L.report(empty).count() == 0
    out = L.without_lines(odd, 2)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_the_joined_way(docs, texts, odd):
    store = L.LineStore(docs.sparkSession, 10, 1).insert(docs)
    got = store.apply(docs.select("doc_id", "text"), limit=0)
    got = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256))
    assert rows(got) == brute(texts)
    store = L.LineStore(odd.sparkSession, 2, 1).insert(odd)
    got = store.apply(odd.select("doc_id", "text"), limit=0)
    assert rows(got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256))) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], 2)


def test_insertions_and_deletions(spark):
    rng = random.Random(6)
    rows_ = [(i, "\n".join(rng.choice("abcdefghijklmnop") for _ in range(6))) for i in range(60)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    a, b, c = rows_[:20], rows_[20:40], rows_[40:]
    store = L.LineStore(spark, 10, 1).insert(frame(a)).insert(frame(b)).delete(frame(a)).insert(frame(c)).delete(frame(b[:10]))
    present = b[10:] + c
    count = Counter(k for _, t in present for k in set(t.split("\n")))
    assert sorted(r["n"] for r in store.counts.collect()) == sorted(count.values())
    got = store.apply(frame(present)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert rows(got) == brute(present)
    empty = store.delete(frame(present))
    assert empty.counts.count() == 0


def test_shards_split_and_only_touched_ones_change(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 8)
    monkeypatch.setattr(L, "PARTS", 3)
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    base = [(i, "\n".join(f"line {j}" for j in range(60))) for i in range(3)]
    more = [(100 + i, f"other {i // 2}") for i in range(12)]
    store = L.LineStore(spark, 2, 1).insert(frame(base))
    blobs = lambda s: {r["shard"]: bytes(r["blob"]) for r in s.filters.collect()}
    assert store.shards == 8 and len(blobs(store)) == 8
    one = store.insert(frame([(200, "new"), (201, "new")]))
    before, after = blobs(store), blobs(one)
    assert sum(before[s] != after[s] for s in before) == 1
    all_ = base + [(200, "new"), (201, "new")] + more
    last = one
    for part in (more[:4], more[4:8], more[8:]):
        last = last.insert(frame(part))
    assert len(last.parts) <= 3 and last.shards == 16
    for limit in (0, 1 << 20):
        got = last.apply(frame(all_), limit=limit).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
        assert rows(got) == brute(all_, 2)
    assert last.delete(frame(more)).counts.count() == 61


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    f = L.CuckooFilter.of_size(5000)
    assert f.insert(keys) and f.has(keys).all()
    f = L.CuckooFilter.of_bytes(f.cells.tobytes())
    f.delete(keys[:2500])
    assert f.has(keys[2500:]).all() and f.has(keys[:2500]).mean() < 0.01
    assert f.has(rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)).mean() < 0.01
    assert not L.CuckooFilter.of_size(10).insert(keys)

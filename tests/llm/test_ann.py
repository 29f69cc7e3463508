from __future__ import annotations

import numpy as np

from weftable.llm import ann as A


def brute(rows, every=20, k=20):
    rows = [(i, np.array(v, np.float64)) for i, v in rows]
    x = np.stack([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for n, (i, v) in enumerate(rows):
        if i % every == 0:
            s = (x * v).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell int, v int, ids string, row int")


def padded(rows):
    return [(i, v, 0, 1, 2, "x", 3) for i, v in rows]


def recall(got, want):
    hit = sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in w}) for q, w in want.items())
    return hit / sum(len(w) for w in want.values())


def test_the_tables(spark):
    for sf in ("sf0.001", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        want = brute([(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"] is not None and any(r["embedding"])])
        got = found(A.report(df))
        assert recall(got, want) >= 0.9 and all(len(g) == 20 for g in got.values())
        for q, hits in got.items():
            assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_small_cells(spark):
    """Many cells: a low recall would show here first."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    rows = [(i, (centres[i % 30] + 0.4 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(4000)]
    df = frame(spark, padded(rows))
    from pyspark.sql import functions as F

    got = found(A.search(df, F.pmod("id", F.lit(20)) == 0, cell_rows=64))
    assert recall(got, brute(rows)) >= 0.9


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = lambda: rng.standard_normal(6).astype(np.float32).tolist()
    same = v()
    rows = [(i, v()) for i in range(1, 30)] + [(i, same) for i in range(100, 140)]
    bad = [(200, None), (220, []), (240, [0.0] * 6), (260, [None] + [1.0] * 5), (280, [float("nan")] + [1.0] * 5), (300, [float("inf")] + [1.0] * 5), (320, [1.0, 2.0]), (None, v())]
    got = found(A.report(frame(spark, padded(rows + bad))))
    want = brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    twice = [(20, same), (20, same), (21, v())]
    got = A.report(frame(spark, padded(twice))).collect()
    assert len(got) == 4 and sorted(r["vec_id"] for r in got) == [20, 20, 21, 21]
    assert A.report(frame(spark, [])).count() == 0
    assert A.report(frame(spark, padded(bad))).count() == 0
    assert A.report(frame(spark, padded([(20, same)]))).count() == 0


def test_chi_square():
    for p, k, x in ((0.95, 1, 3.841), (0.95, 8, 15.507), (0.99, 10, 23.209), (0.5, 2, 1.386)):
        assert abs(A.chi_square_quantile(p, k) - x) < 1e-2


def test_the_query_itself_does_not_stop_the_search():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 24))
    x /= np.sqrt((x * x).sum(1))[:, None]
    cell = A.Cell(A.Cells.drawn(24, 1 + 1e-9, 0), x, [[i] for i in range(len(x))])
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -2
    found = cell.search(x[:200], np.full(200, np.inf), 1, A.chi_square_quantile(0.98, A.DIMS))
    assert np.mean([s[i].argmax() in f for i, f in enumerate(found)]) >= 0.9


def test_more_ties_than_k(spark):
    """Sixty vectors of one score with the query: those of the smallest ids are the answer, in whatever order they lie."""
    rng = np.random.default_rng(6)
    tied = [(1000 - i, [1.0, *rng.permutation([1.0, *[0.0] * 30]).tolist()]) for i in range(60)]
    rows = [(20, [1.0, *[0.0] * 31]), *tied, *[(3000 + i, [0.5, *[0.0] * 30, float(i)]) for i in range(1, 600)]]
    got = found(A.search(frame(spark, padded(rows)), A.F.col("id") == 20, k=20, cell_rows=64, confidence=0.999))
    want = sorted({tuple(v): i for i, v in tied}.items(), key=lambda x: x[1])
    assert [j for j, _ in got[20]] == sorted(i for i, _ in tied)[:20] and want


def test_even_vectors_in_small_cells(spark):
    """Unit vectors spread evenly, many cells: what the first cells lack, the second phase must find."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12_000, 24)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = frame(spark, padded(rows))
    got = found(A.search(df, A.F.pmod("id", A.F.lit(200)) == 0, cell_rows=128))
    assert recall(got, brute(rows, every=200)) >= 0.9

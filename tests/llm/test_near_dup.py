from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from weftable.llm import near_dup as N
from weftable.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(rows, n=4):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    seen = set()
    for ids in by.values():
        ids = sorted(ids)
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(parent, a), find(parent, b)
                        parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(parent, i), find(parent, i) == i) for i in sets)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_the_tables(docs, texts):
    want = brute(texts)
    assert sum(not r[3] for r in want) > 0
    assert rows(N.groups(docs, 4)) == want


def test_chains_hubs_and_groups(spark):
    """Many variants of few texts: links near the threshold, chains, and buckets with several components."""
    rng = random.Random(8)
    out = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(60)]
        for _ in range(30):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = f"v{rng.randrange(3000)}"
            if rng.random() < 0.3:
                base = t
            out.append((rng.randrange(1 << 40), " ".join(t)))
    out += [(-5, "one"), (-4, "One "), (-3, "one two three"), (-2, "one two three four"), (-1, "")]
    for n in (4, 5):
        assert rows(N.groups(spark.createDataFrame(out, "doc_id long, text string"), n)) == brute(out, n)


def test_odd_rows(odd, empty):
    got = sorted(map(tuple, N.groups(odd).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == odd.count() and by[5][2] == 4 and by[1] == (1, 0, 1, True) and by[3][2] == 3 and by[None][3]
    assert by[7][2] == 7
    assert N.groups(empty).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2000, 2050)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    want = {(x, find(parent, x)) for x in linked if find(parent, x) != x}
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {r for r in got if r[0] != r[1]} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).filter(F.col("node") != F.col("component")).count() == 0

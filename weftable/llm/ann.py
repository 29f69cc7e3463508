"""Nearest neighbours by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected to DIMS dimensions by a Gaussian (2-stable) matrix: for a pair at distance d, the squared
projected distance is d² times a chi-square variable of DIMS degrees of freedom. A kd-tree of the projections
gives the neighbours of a projected query in order of projected distance; each is verified on the original
vectors, and the search of a query stops as soon as the test holds: the chance that a vector nearer than its
present k-th one has a projected distance beyond the next in order is below 1 - CONFIDENCE.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M² - |x|²) for vectors and 0 for
queries, M being the largest norm.

Distribution. The upper levels of the kd-tree are cut on a sample of SAMPLE projections (a documented bound, projected
where they are read); every vector is then in one cell. A cell, or where cells are large a part of one, is a group that one task holds, while
the queries that visit it stream past. A query first goes to its NEAR nearest cells, which give
it a first k-th distance, then to those other cells that the stopping test does not rule out; inside a cell, leaves
are visited in order of projected distance under the same test. A cell answers a query in one row. Equal vectors are one entry that keeps the k + 1
smallest ids (with ties to smaller ids, others can't be in any answer), so a very common vector is one row.

Defined results: ids are integers; vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
those of another length than the most common one; null ids take no part; fewer candidates than k give all of
them; rows that repeat an id are queries and candidates of their own; ties go to the smaller id, also
where more than k vectors tie; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftable.llm.common import scratch, written

DIMS = 8
CONFIDENCE = 0.98
LEAF = 256
SAMPLE = 200_000
CELL_ROWS, LEVELS = 1024, 16
#: Vectors of a cell that one task holds, on average.
PART_ROWS = 8192
#: Queries whose distances to all cells are held at once.
AT_ONCE = 256
#: Rows of a batch of visits, each with the query's vector.
VISITS = 4096
HITS = pa.list_(pa.struct([("score", pa.float64()), ("other", pa.int64())]))
#: Cells that a query visits before it has a k-th distance.
NEAR = 6


def chi_square_quantile(p: float, k: int) -> float:
    """Quantile by bisection of the regularised lower incomplete gamma function."""
    from math import exp, lgamma, log

    def cdf(x: float) -> float:
        if x <= 0:
            return 0.0
        a, x = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= x / n
            total += term
        return total * exp(-x + a * log(x) - lgamma(a))

    low, high = 0.0, 20.0 * k + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


@dataclass
class Cells:
    """The upper levels of the kd-tree: a complete binary tree of cuts; and the projection."""

    matrix: np.ndarray  # (d + 1, DIMS)
    bound: float  # M, the largest norm
    levels: int
    axis: np.ndarray  # of inner nodes, heap order
    cut: np.ndarray

    @classmethod
    def drawn(cls, d: int, bound: float, levels: int, seed: int = 11) -> Cells:
        return cls(np.random.default_rng(seed).standard_normal((d + 1, DIMS)), bound, levels, np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1))

    def cut_on(self, projections: np.ndarray) -> Cells:
        """Cuts the tree at medians of the projections along their widest axes."""
        parts = {0: projections}
        for node in range((1 << self.levels) - 1):
            x = parts.pop(node)
            if len(x):
                self.axis[node] = int(np.argmax(x.max(0) - x.min(0)))
                self.cut[node] = float(np.median(x[:, self.axis[node]]))
            left = x[:, self.axis[node]] < self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = x[left], x[~left]
        return self

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.bound**2 - (x * x).sum(1)))
        return x @ self.matrix[:-1] + extra[:, None] * self.matrix[-1]

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] >= self.cut[node])
        return node - ((1 << self.levels) - 1)

    def _beside(self, node: np.ndarray | int, off: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of points from both children of a node, given those from the node."""
        at = np.broadcast_to(np.asarray(self.axis[node])[..., None], (*off.shape[:-1], 1))
        gap = np.take_along_axis(np.broadcast_to(p, off.shape), at, -1) - np.asarray(self.cut[node])[..., None]
        was = np.take_along_axis(off, at, -1)
        left, right = off.copy(), off.copy()
        np.put_along_axis(left, at, np.maximum(was, np.maximum(gap, 0)), -1)
        np.put_along_axis(right, at, np.maximum(was, np.maximum(-gap, 0)), -1)
        return left, right

    def nearest(self, p: np.ndarray, count: int) -> np.ndarray:
        """(n, count) cells near to each point: the nearest of those that a search of the tree meets which keeps
        4 * count nodes of a level."""
        node, off = np.zeros((len(p), 1), np.int64), np.zeros((len(p), 1, DIMS))
        for _ in range(self.levels):
            left, right = self._beside(node, off, p[:, None, :])
            node, off = np.concatenate([2 * node + 1, 2 * node + 2], 1), np.concatenate([left, right], 1)
            if node.shape[1] > 4 * count:
                keep = np.argsort((off * off).sum(2), 1, kind="stable")[:, : 4 * count]
                node, off = np.take_along_axis(node, keep, 1), np.take_along_axis(off, keep[..., None], 1)
        order = np.argsort((off * off).sum(2), 1, kind="stable")[:, :count]
        return np.take_along_axis(node, order, 1) - ((1 << self.levels) - 1)

    def within(self, p: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of every cell whose squared projected distance is at most the point's limit."""
        inner, points, cells = (1 << self.levels) - 1, [], []
        stack = [(0, np.arange(len(p)), np.zeros((len(p), DIMS)))]
        while stack:
            node, at, off = stack.pop()
            if node >= inner:
                points.append(at)
                cells.append(np.full(len(at), node - inner))
                continue
            for child, o in zip((2 * node + 1, 2 * node + 2), self._beside(node, off, p[at])):
                ok = (o * o).sum(1) <= limit[at]
                if ok.any():
                    stack.append((child, at[ok], o[ok]))
        return (np.concatenate(points), np.concatenate(cells)) if points else (np.empty(0, np.int64), np.empty(0, np.int64))


def leaves(p: np.ndarray) -> list[np.ndarray]:
    """Leaves of a kd-tree over p as index arrays of at most LEAF points (points that are all equal stay together)."""
    out, stack = [], [np.arange(len(p))]
    while stack:
        at = stack.pop()
        spread = np.ptp(p[at], axis=0) if len(at) > LEAF else None
        if spread is None or spread.max() == 0:
            out.append(at)
            continue
        axis = int(spread.argmax())
        half = len(at) // 2
        order = at[np.argpartition(p[at, axis], half)]
        stack += [order[:half], order[half:]]
    return out


class Cell:
    """The vectors of a cell (or a part of one), with the lower levels of the kd-tree over them."""

    def __init__(self, cells: Cells, x: np.ndarray, ids: list[list[int]]) -> None:
        self.cells, self.x, self.ids = cells, x, ids
        p = cells.project(x, False)
        self.tree = leaves(p)
        self.low = np.stack([p[a].min(0) for a in self.tree])
        self.high = np.stack([p[a].max(0) for a in self.tree])

    def search(self, q: np.ndarray, reach: np.ndarray, k: int, stop: float) -> list[np.ndarray]:
        """For each query, indices of the vectors that may be among its k best, with all that tie: leaves are visited in order of
        projected distance until the stopping test holds. reach: squared k-th distances known so far (inf: none)."""
        pq = self.cells.project(q, True)
        gap = np.zeros((len(q), len(self.tree)))
        for d in range(DIMS):
            g = np.maximum(np.maximum(self.low[None, :, d] - pq[:, None, d], pq[:, None, d] - self.high[None, :, d]), 0)
            gap += g * g
        order = np.argsort(gap, 1, kind="stable")
        width = k + 1
        best = np.full((len(q), width), -np.inf)  # of inner products
        norms = (q * q).sum(1) + self.cells.bound**2
        slack = 1e-9 * np.maximum(norms, 1e-30)  # products of equal rank may differ in their last digits
        live = np.arange(len(q))
        by_query: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(len(self.tree)):
            # the query itself may be among the best of any cell, so the k-th other is the last of the k + 1
            known = np.minimum(reach[live], norms[live] - 2 * best[live, 0])
            nearest = gap[live, order[live, step]]
            live = live[nearest <= stop * np.maximum(known, 0) * (1 + 1e-9) + 1e-12]
            if not len(live):
                break
            leaf = order[live, step]
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by])) + 1
            for rows in np.split(live[by], cuts):
                at = self.tree[order[rows[0], step]]
                s = q[rows] @ self.x[at].T
                both = np.concatenate([best[rows], s], 1)
                both.partition(both.shape[1] - width, axis=1)
                best[rows] = both[:, -width:]  # the least of them first
                i, j = np.nonzero(s >= (best[rows, 0] - slack[rows])[:, None])
                by_query.append((rows[i], at[j], s[i, j]))
        if not by_query:
            return [np.empty(0, np.int64)] * len(q)
        who, at, s = (np.concatenate(c) for c in zip(*by_query))
        fine = s >= (best[:, 0] - slack)[who]  # all ties of the last score stay
        who, at = who[fine], at[fine]
        at = at[np.argsort(who, kind="stable")]
        return np.split(at, np.cumsum(np.bincount(who, minlength=len(q)))[:-1])

    def answers(self, asked: pa.RecordBatch, k: int, stop: float) -> pa.RecordBatch:
        """row, id and hits of the queries that find something here."""
        rows, ids, answers = [], [], []
        q, reach = matrix(asked.column("v")), asked.column("reach").to_numpy(zero_copy_only=False)
        who, own_ids = asked.column("row").to_pylist(), asked.column("id").to_pylist()
        for i, found in enumerate(self.search(q, reach, k, stop)):
            s = scores(self.x[found], q[i])
            near = (q[i] * q[i]).sum() + self.cells.bound**2 - 2 * s <= reach[i] * (1 + 1e-9) + 1e-9
            found, s = found[near], s[near]
            hits = sorted((-v, o) for f, v in zip(found.tolist(), s.tolist()) for o in self.ids[f])
            own = (-float(scores(q[i : i + 1], q[i])[0]), own_ids[i])
            if own in hits:  # a query is no candidate of its own, once
                hits.remove(own)
            if hits:
                rows.append(who[i])
                ids.append(own_ids[i])
                answers.append([{"score": -v, "other": o} for v, o in hits[:k]])
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(answers, HITS)], names=["row", "id", "hits"])


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v: array<double>, the rows that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    slim = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return slim.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with one query, summed in the same order for equal rows."""
    return (x * q).sum(1)


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, <id_col>, score: the k nearest found of each query; is_query is a condition on the column id."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    rows = vectors(df, id_col, vec_col)
    lengths = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not lengths:
        return empty
    d = max(lengths, key=lambda x: (lengths[x], x))
    with scratch(spark) as s:
        return s.result(_found(rows.filter(F.size("v") == d), d, is_query, k, id_col, confidence, cell_rows), "ann-found")


def _found(rows: DataFrame, d: int, is_query: Column, k: int, id_col: str, confidence: float, cell_rows: int) -> DataFrame:
    spark = rows.sparkSession
    # equal vectors: one entry with the k + 1 smallest ids, found below each task first
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = written(rows.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-entries")
    queries = written(rows.filter(is_query).withColumn("row", F.monotonically_increasing_id()), "ann-queries")
    n, norm = entries.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / cell_rows)))))
    cells = Cells.drawn(d, float(np.sqrt(norm or 0)) * (1 + 1e-9), levels)
    stop = chi_square_quantile(confidence, DIMS)

    def projected(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(cells.project(matrix(b.column("v")), False).ravel()), DIMS).cast(pa.list_(pa.float64()))], names=["p"])

    span = 1 << 30
    picked = entries.filter(F.pmod(F.xxhash64("v"), F.lit(span)) < F.lit(min(span, SAMPLE * span // max(1, n) + 1))).select("v")
    picked = picked.mapInArrow(projected, "p array<double>").limit(2 * SAMPLE).toArrow()
    cells.cut_on(matrix(picked.column("p")) if picked.num_rows else np.zeros((1, DIMS)))
    shared = spark.sparkContext.broadcast(cells)

    def place(batches):
        c = shared.value
        for b in batches:
            home = c.cell(c.project(matrix(b.column("v")), False))
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), b.column("v"), b.column("ids")], names=["cell", "v", "ids"])

    # a cell of more than PART_ROWS vectors is dealt to several tasks, each of which its queries ask
    parts = max(1, -(-n // (PART_ROWS << levels)))
    placed = entries.mapInArrow(place, "cell bigint, v array<double>, ids array<bigint>").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))

    def asked_of(batches, first: bool):
        c = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(i, AT_ONCE)
                q = matrix(b.column("v"))
                p = c.project(q, True)
                near = c.nearest(p, NEAR)
                if first:
                    at, cell = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel()
                    reach = np.full(len(q), np.inf)
                else:
                    kth = b.column("kth").to_numpy(zero_copy_only=False).astype(float)
                    reach = np.where(np.isnan(kth), np.inf, (q * q).sum(1) + c.bound**2 - 2 * kth)
                    at, cell = c.within(p, stop * np.maximum(reach, 0) * (1 + 1e-9) + 1e-12)
                    new = ~np.isin(at << LEVELS | cell, (np.arange(len(q))[:, None] << LEVELS | near).ravel())
                    at, cell = at[new], cell[new]
                for j in range(0, len(at), VISITS):
                    take = pa.array(at[j : j + VISITS])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[j : j + VISITS], pa.int64()), *(b.column(n).take(take) for n in ("row", "id", "v")), pa.array(reach[at[j : j + VISITS]])], names=["cell", "row", "id", "v", "reach"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of a part come first and are held; queries follow and stream."""
        held: list[pa.RecordBatch] = []
        cell = None
        for b in batches:
            is_query = b.column("is_query")
            mine, others = b.filter(pc.invert(is_query)), b.filter(is_query)
            if mine.num_rows:
                if cell is not None:
                    raise RuntimeError("a vector after a query")
                held.append(mine.select(["v", "ids"]))
            if others.num_rows and held:
                if cell is None:
                    x = pa.Table.from_batches(held)
                    cell = Cell(shared.value, matrix(x.column("v")), x.column("ids").to_pylist())
                for a in range(0, others.num_rows, 512):
                    out = cell.answers(others.slice(a, 512), k, stop)
                    if out.num_rows:
                        yield out

    def meet(asked_: DataFrame) -> DataFrame:
        asks = asked_.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).cast("bigint")) if parts > 1 else asked_.withColumn("part", F.lit(0).cast("bigint"))
        both = placed.withColumn("is_query", F.lit(False)).unionByName(asks.withColumn("is_query", F.lit(True)), allowMissingColumns=True)
        dealt = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "is_query")
        return dealt.groupBy("cell", "part").applyInArrow(visit, found)

    asked, found = "cell bigint, row bigint, id bigint, v array<double>, reach double", "row bigint, id bigint, hits array<struct<score:double,other:bigint>>"
    first = queries.mapInArrow(lambda b: asked_of(b, True), asked)
    near = meet(first)
    if 1 << levels > NEAR:
        near = written(near, "ann-near")
        kth = F.get(F.reverse(F.array_sort(F.flatten(F.collect_list("hits.score")))), F.lit(k - 1))
        known = queries.join(near.groupBy("row").agg(kth.alias("kth")), "row", "left").select("row", "id", "v", "kth")
        more = meet(known.mapInArrow(lambda b: asked_of(b, False), asked))
        near = near.unionByName(more)
    each = near.select("row", "id", F.explode("hits").alias("h")).select("row", "id", "h.score", "h.other")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "other")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("other").alias(id_col), "score")


def report(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return search(df, F.pmod(F.col("id"), F.lit(every)) == 0, k, id_col, vec_col)

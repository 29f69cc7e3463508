"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; keys are told apart
by a 128-bit hash. The exact counts hold, for each key, the number of document rows that have it; documents are
inserted by adding their distinct keys and deleted by subtracting them, so the counts are at any time those of the
documents present. They are a base table and at most PARTS tables of changes, which are then added up into a new
base: a change writes what it changes and no more. Beside them, one cuckoo filter for each shard of the key space
holds the keys whose count has reached the threshold; keys that cross it upwards are inserted and those that cross
it downwards deleted. Only shards with such keys are written anew; when shards hold more than SHARD_KEYS keys on
average, they are split.

A cuckoo filter never misses a key and seldom claims one too many. The claims it makes wrongly about counted keys
are listed by one pass over the counts, so "in the filter and not in that list" is exact for every document that is
counted. Filters and list are broadcast where their measured size is at most BROADCAST_BYTES; texts are then not
shuffled at all. Beyond that, keys of texts go to the filter of their shard (a shard is dealt to several tasks, each
with the filter, and keys stream past it), what it claims is joined with the exact counts, and the texts are joined
with what is left by their digests, once.

Defined results: null or empty text is one empty line, which has no key of a code point or more and stays;
repeated rows count as documents of their own; a null doc_id is a value like any other; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftable.llm.common import map_blocks, scratch, text_udf, utf8, written

SHARD_KEYS = 400_000
#: Tables of changes beside the base of the counts.
PARTS = 8
#: Keys of a shard that one task asks about, on average.
ASKED_KEYS = 2_000_000
BROADCAST_BYTES = 64 << 20
SLOTS, KICKS = 4, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports deletion of keys that were inserted."""

    def __init__(self, buckets: int, cells: np.ndarray | None = None) -> None:
        self.mask = buckets - 1  # buckets is a power of two
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def of_size(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.7))))))

    @classmethod
    def of_bytes(cls, blob: bytes) -> CuckooFilter:
        cells = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(cells), cells)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys (n, 2) uint64 -> fingerprint and both buckets of each."""
        print_ = ((keys[:, 1] >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint64)
        first = keys[:, 1] & np.uint64(self.mask)
        with np.errstate(over="ignore"):
            other = first ^ ((print_ * _MIX) >> np.uint64(20)) & np.uint64(self.mask)
        return print_.astype(np.uint16), first.astype(np.int64), other.astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self.places(keys)
        return (self.cells[a] == p[:, None]).any(1) | (self.cells[b] == p[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False when the filter is too full; it must then be rebuilt at a larger size from the exact table."""
        cells, mask = self.cells, self.mask
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for i in (a, b):
                free = np.flatnonzero(cells[i] == 0)
                if len(free):
                    cells[i, free[0]] = p
                    break
            else:
                i = a
                for kick in range(KICKS):
                    slot = (kick + p) % SLOTS
                    p, cells[i, slot] = int(cells[i, slot]), p
                    i ^= ((p * int(_MIX) & (1 << 64) - 1) >> 20) & mask
                    free = np.flatnonzero(cells[i] == 0)
                    if len(free):
                        cells[i, free[0]] = p
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for i in (a, b):
                found = np.flatnonzero(self.cells[i] == p)
                if len(found):
                    self.cells[i, found[0]] = 0
                    break


def line_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The 128-bit key of each line; None for keys of fewer code points than min_chars."""
    digest = xxhash.xxh3_128_digest
    keys = map(bytes.strip, (text or b"").lower().split(b"\n"))
    if min_chars <= 1:
        return [digest(k) if k or not min_chars else None for k in keys]
    return [digest(k) if len(k.decode("utf-8", "replace")) >= min_chars else None for k in keys]


def as_pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)


def key_counts(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(k1, k2, n): how many rows have each key. Counted inside each block first, so a common line is a few rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found: Counter = Counter()
        for text in utf8(batch.column("text")):
            found.update(set(line_keys(text, min_chars)))
        found.pop(None, None)
        if not found:
            return None
        pairs = as_pairs(list(found)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(list(found.values()), pa.int64())], names=["k1", "k2", "n"])

    slim = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_blocks(slim, "text", run, "k1 bigint, k2 bigint, n bigint").groupBy("k1", "k2").agg(F.sum("n").alias("n"))


@dataclass
class LineStore:
    """The exact reference counts and the filters of a set of documents; insert() and delete() give the store after.

    Its tables are in the shared folder, and go with the scratch() that it is used in."""

    spark: SparkSession
    threshold: int
    min_chars: int
    parts: tuple[DataFrame, ...] = ()  # k1, k2, n: counts and changes of them
    filters: DataFrame | None = None  # shard, blob
    shards: int = 1

    @property
    def counts(self) -> DataFrame:
        """k1, k2, n of the keys that are there."""
        if not self.parts:
            return self.spark.createDataFrame([], "k1 bigint, k2 bigint, n bigint")
        if len(self.parts) == 1:
            return self.parts[0].filter("n > 0")
        return reduce(DataFrame.unionByName, self.parts).groupBy("k1", "k2").agg(F.sum("n").alias("n")).filter("n > 0")

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineStore:
        return self._changed(key_counts(docs, text_col, self.min_chars))

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineStore:
        """Takes back documents that were inserted before."""
        return self._changed(key_counts(docs, text_col, self.min_chars).withColumn("n", -F.col("n")))

    def _changed(self, delta: DataFrame) -> LineStore:
        t = self.threshold
        delta = written(delta, "line-changes")
        after = LineStore(self.spark, t, self.min_chars, (*self.parts, delta), self.filters, self.shards)
        if len(after.parts) > PARTS:
            after.parts = (written(after.counts, "line-counts"),)
        frequent = after.counts.filter(F.col("n") >= t)
        if self.parts:
            changed = delta.withColumnRenamed("n", "d").join(self.counts, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.col("d")).alias("n"))
            many = frequent.count()
        else:
            changed = delta.select("k1", "k2", F.lit(0).cast("bigint").alias("was"), "n")
            many = delta.filter(F.col("n") >= t).count()
        wanted = 1 << max(0, (-(-many // SHARD_KEYS) - 1).bit_length())
        if self.filters is None or wanted > self.shards:
            after.shards = max(wanted, self.shards)
            after.filters = written(_filters(_sharded(frequent, after.shards)), "line-filters")
            return after
        crossing = _sharded(changed.filter((F.col("was") < t) != (F.col("n") < t)), self.shards)
        crossing = written(crossing.select("shard", "k1", "k2", (F.col("n") >= t).alias("up")), "line-crossing")
        touched = crossing.select("shard").distinct()
        renewed = self.filters.join(touched, "shard", "left_semi").groupBy("shard").cogroup(crossing.groupBy("shard")).applyInArrow(_renewed, "shard int, blob binary")
        renewed = written(renewed, "line-renewed")
        # a filter that is full has no blob now: it is made anew from the exact counts
        full = renewed.filter("blob is null").select("shard")
        anew = _filters(_sharded(frequent, self.shards).join(full, "shard", "left_semi"))
        kept = self.filters.join(touched, "shard", "left_anti")
        after.filters = written(kept.unionByName(renewed.filter("blob is not null")).unionByName(anew), "line-filters")
        return after

    def _broadcastable(self, limit: int):
        """Filters and the list of their wrong claims, if together within the limit; else None."""
        size = self.filters.agg(F.sum(F.length("blob"))).first()[0] or 0
        if size > limit:
            return None
        sc, shards = self.spark.sparkContext, self.shards
        shared = sc.broadcast({r["shard"]: bytes(r["blob"]) for r in self.filters.collect()})
        rare = self.counts.filter(F.col("n") < self.threshold)

        def claimed(batches):
            ask = Filters(shared.value, shards)
            for b in batches:
                pairs = np.stack([b.column(c).to_numpy() for c in ("k1", "k2")], 1).view(np.uint64)
                yield b.select(["k1", "k2"]).filter(pa.array(ask.has(pairs)))

        most = limit // 256  # entries of the list; each is some 100 bytes in a worker
        wrong = rare.select("k1", "k2").mapInArrow(claimed, "k1 bigint, k2 bigint").limit(most + 1).toArrow()
        if wrong.num_rows > most:
            return None
        flat = np.stack([wrong.column(c).to_numpy() for c in ("k1", "k2")], 1).astype(">i8").tobytes()
        not_these = {flat[i : i + 16] for i in range(0, len(flat), 16)}
        return sc.broadcast((shared.value, shards, not_these))

    def apply(self, docs: DataFrame, text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
        """docs with n_lines, n_dropped and kept (the text without frequent lines; null where the text is null).

        Exact for documents that the store counts. Columns of docs by the names of the new ones give way.
        """
        made = ("n_lines", "n_dropped", "kept")
        return self.judged(docs, text_col, limit).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in made], *made)

    def judged(self, docs: DataFrame, text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
        """The same with the columns of docs in one column, row."""
        text = F.col(f"`{text_col}`").cast("string")
        slim = docs.select(text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        if (found := self._broadcastable(limit)) is None:
            return self._joined(slim)
        asked: list[Filters] = []
        min_chars = self.min_chars

        def run(column: pa.Array) -> pa.Array:
            blobs, shards, not_these = found.value
            if not asked:
                asked.append(Filters(blobs, shards))
            texts = utf8(column)
            keys = [line_keys(t, min_chars) for t in texts]
            flat = list({k for ks in keys for k in ks if k is not None})
            hit = set() if not flat else {k for k, h in zip(flat, asked[0].has(as_pairs(flat)).tolist()) if h} - not_these
            return without(texts, keys, [hit] * len(texts))

        return _shown(slim.select("text", "row", text_udf(run, CHANGED)(F.col("text")).alias("made")))

    def _joined(self, slim: DataFrame) -> DataFrame:
        """The way for stores beyond the limit: keys meet their shard's filter, claims the exact counts."""
        min_chars, shards = self.min_chars, self.shards
        slim = slim.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))

        def keys(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found: dict[bytes, set] = {}
            for d, t in zip(batch.column("digest").to_pylist(), utf8(batch.column("text"))):
                if d not in found:
                    found[d] = set(line_keys(t, min_chars)) - {None}
            what = [k for ks in found.values() for k in ks]
            if not what:
                return None
            pairs = as_pairs(what).view(np.int64)
            who = [d for d, ks in found.items() for _ in ks]
            return pa.RecordBatch.from_arrays([pa.array(who, pa.binary()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["digest", "k1", "k2"])

        asked = written(_sharded(map_blocks(slim.select("digest", "text"), "text", keys, "digest binary, k1 bigint, k2 bigint"), shards), "line-asked")
        ways = max(1, -(-asked.count() // (shards * ASKED_KEYS)))
        sides = [
            self.filters.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).withColumn("is_key", F.lit(False)),
            asked.withColumn("way", F.pmod(F.xxhash64("digest"), F.lit(ways)).cast("int")).withColumn("is_key", F.lit(True)),
        ]

        def claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The filter comes first; keys stream past it."""
            held = None
            for b in batches:
                is_key = b.column("is_key")
                for blob in b.filter(pc.invert(is_key)).column("blob").to_pylist():
                    held = CuckooFilter.of_bytes(blob)
                b = b.filter(is_key)
                if held is not None and b.num_rows:
                    pairs = np.stack([b.column(c).to_numpy() for c in ("k1", "k2")], 1).view(np.uint64)
                    yield b.select(["digest", "k1", "k2"]).filter(pa.array(held.has(pairs)))

        dealt = sides[0].unionByName(sides[1], allowMissingColumns=True).repartition("shard", "way").sortWithinPartitions("shard", "way", "is_key")
        claims = dealt.groupBy("shard", "way").applyInArrow(claimed, "digest binary, k1 bigint, k2 bigint")
        frequent = self.counts.filter(F.col("n") >= self.threshold).select("k1", "k2")
        hits = claims.distinct().join(frequent, ["k1", "k2"]).groupBy("digest").agg(F.collect_list(F.struct("k1", "k2")).alias("hits"))
        joined = slim.join(written(hits, "line-hits"), "digest", "left")

        def run(column: pa.Array) -> pa.Array:
            texts = utf8(column.field("text"))
            hits = [{(h["k1"] & (1 << 64) - 1).to_bytes(8, "big") + (h["k2"] & (1 << 64) - 1).to_bytes(8, "big") for h in hs or ()} for hs in column.field("hits").to_pylist()]
            return without(texts, [line_keys(t, min_chars) for t in texts], hits)

        made = F.arrow_udf(run, CHANGED)(F.struct("text", "hits"))
        return _shown(joined.select("text", "row", made.alias("made")))


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    """A key's shard is by its first half; its places in the filter come from the second."""
    return keys.withColumn("shard", F.col("k1").bitwiseAND(F.lit(shards - 1)).cast("int"))


def _pairs(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in ("k1", "k2")], 1).view(np.uint64) if table.num_rows else np.empty((0, 2), np.uint64)


def _filter_row(shard: int, f: CuckooFilter | None) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "blob": pa.array([f.cells.tobytes() if f else None], pa.binary())})


def _filters(keys: DataFrame) -> DataFrame:
    """A filter for each shard of these keys."""

    def made(table: pa.Table) -> pa.Table:
        pairs = _pairs(table)
        size = len(pairs)
        while not (f := CuckooFilter.of_size(size)).insert(pairs):
            size = 2 * size + 16
        return _filter_row(table.column("shard")[0].as_py(), f)

    return keys.select("shard", "k1", "k2").groupBy("shard").applyInArrow(made, "shard int, blob binary")


def _renewed(old: pa.Table, crossing: pa.Table) -> pa.Table:
    """A shard's filter after a change; no blob where the keys don't fit any more."""
    pairs, up = _pairs(crossing), crossing.column("up").to_numpy(zero_copy_only=False)
    f = CuckooFilter.of_bytes(old.column("blob")[0].as_py()) if old.num_rows else CuckooFilter.of_size(int(up.sum()))
    f.delete(pairs[~up])
    return _filter_row(crossing.column("shard")[0].as_py(), f if f.insert(pairs[up]) else None)


#: What Python says of a text: kept only where lines are gone.
CHANGED = "n_lines bigint, n_dropped bigint, kept string"


def without(texts: list[bytes | None], keys: list[list[bytes | None]], hits: list[set[bytes]]) -> pa.Array:
    """Texts without the lines whose keys are among their hits."""
    dropped, kept = [], []
    for text, ks, hit in zip(texts, keys, hits):
        gone = [k in hit for k in ks] if hit else ()
        dropped.append(sum(gone))
        kept.append(b"\n".join(x for x, g in zip((text or b"").split(b"\n"), gone) if not g) if dropped[-1] else None)
    return pa.StructArray.from_arrays([pa.array(map(len, keys), pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["n_lines", "n_dropped", "kept"])


def _shown(df: DataFrame) -> DataFrame:
    """row, n_lines, n_dropped, kept."""
    return df.select("row", "made.n_lines", "made.n_dropped", F.when(F.col("made.n_dropped") > 0, F.col("made.kept")).otherwise(F.col("text")).alias("kept"))


class Filters:
    """All shards' filters, asked together."""

    def __init__(self, blobs: dict[int, bytes], shards: int) -> None:
        self.of = {s: CuckooFilter.of_bytes(b) for s, b in blobs.items()}
        self.shards = shards

    def has(self, pairs: np.ndarray) -> np.ndarray:
        if self.shards == 1:
            return self.of[0].has(pairs) if self.of else np.zeros(len(pairs), bool)
        out = np.zeros(len(pairs), bool)
        shard = (pairs[:, 0] & np.uint64(self.shards - 1)).astype(np.int64)
        for s, f in self.of.items():
            at = np.flatnonzero(shard == s)
            if len(at):
                out[at] = f.has(pairs[at])
        return out


def dedup_lines(docs: DataFrame, threshold: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept, lines judged by all of docs."""
    return LineStore(docs.sparkSession, threshold, min_chars).insert(docs, text_col).apply(docs, text_col)


def without_lines(docs: DataFrame, threshold: int = 10, min_chars: int = 1, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs without their frequent lines, with the columns of docs; size_col, where there is one, follows the text."""
    out = LineStore(docs.sparkSession, threshold, min_chars).insert(docs, text_col).judged(docs, text_col)

    def column(c: str):
        old = F.col("row").getField(c)
        if c == text_col:
            return F.col("kept").alias(c)
        if c == size_col:
            old = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema[c].dataType)).otherwise(old)
        return old.alias(c)

    return out.select(*map(column, docs.columns))


def report(docs: DataFrame, threshold: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    with scratch(docs.sparkSession) as s:
        out = dedup_lines(docs.select(id_col, text_col), threshold, min_chars, text_col)
        return s.result(out.select(id_col, "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")), "line-dedup")

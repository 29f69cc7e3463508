"""Benchmark decontamination by winnowing.

Words are runs of `[0-9a-z]` and non-ASCII characters after lower-casing A-Z. From every window of
WINDOW - K + 1 consecutive K-grams, of a document and of a benchmark item alike, the K-grams of minimum hash
are kept as fingerprints. Any span of WINDOW words is such a window, so a shared span of at least WINDOW
words always shares a fingerprint. Documents' fingerprints are joined with the benchmark's; each hit is
extended to the WINDOW-word spans around it, which are compared word by word with the item's. Items shorter
than WINDOW words are one window each and are looked up at their own length.

Neither side passes through the driver. The benchmark's fingerprints and windows are tables; of their hashes the
executors make one bitmap of at most SIEVE_BITS bits (32 MB), the only thing that is broadcast, whatever the
benchmark's size. Documents are read once: a fingerprint that the bitmap lets through is extended to the windows
around it, and windows that pass it as well are candidates, few rows beside the text. They are joined with the
benchmark's windows by their words, so a result never rests on a hash. Texts that are equal are joined once.

Defined results: null or wordless texts have no words and no hits; null, wordless and repeated items are
allowed (a wordless item is never found; repeated item_ids count once); a repeated document row gives its
own result row; empty tables on either side work; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from weftable.llm.common import key_and_text, map_blocks, scratch, utf8, written
from weftable.llm.words import gram_hashes, word_hashes

WINDOW, K = 10, 6
#: The bitmap has 16 bits for each distinct hash, to at most these; beyond them it lets more candidates through.
SIEVE_BITS = 1 << 28
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def fingerprints(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-grams that are minimal in a window of window - k + 1 of them; ties all stay."""
    grams = gram_hashes(words, k)
    w = window - k + 1
    n = len(grams) - w + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = grams[:n].copy()
    for j in range(1, w):
        np.minimum(low, grams[j : n + j], out=low)
    keep = np.zeros(len(grams), bool)
    for j in range(w):
        keep[j : n + j] |= grams[j : n + j] == low
    at = np.flatnonzero(keep)
    return at, grams[at]


def salted(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of one kind (a window's length; 0 for fingerprints) kept apart from those of others."""
    with np.errstate(over="ignore"):
        return (hashes ^ np.uint64(kind + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)


def windows(benchmark: DataFrame) -> DataFrame:
    """item, words (joined by a space) and hash of each item's windows; rows of a null item hold fingerprints."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, spans, hashes, sizes = [], [], [], []
        for item, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            words = words_of(text)
            if not words:
                continue
            n, h = min(len(words), WINDOW), word_hashes(words)
            name = "null" if item is None else str(item)
            found: dict[bytes, int] = {}
            for i, g in enumerate(salted(gram_hashes(h, n), n).view(np.int64).tolist()):
                found.setdefault(b" ".join(words[i : i + n]), g)
            prints = set(salted(fingerprints(h)[1], 0).view(np.int64).tolist())
            items += [name] * len(found) + [None] * len(prints)
            spans += [*(w.decode() for w in found), *[None] * len(prints)]
            sizes += [n] * len(found) + [0] * len(prints)
            hashes += [*found.values(), *prints]
        return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(spans, pa.string()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], names=["item", "words", "n", "hash"])

    return map_blocks(benchmark, "text", run, "item string, words string, n int, hash bigint").distinct()


class Sieve:
    """The bitmap of hashes that the benchmark has, and the lengths of its windows."""

    def __init__(self, bits: np.ndarray, sizes: list[int]) -> None:
        self.bits, self.sizes = bits, sizes

    def passes(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        at = salted(hashes, kind) & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def candidates(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Windows that may be the benchmark's -> where they start."""
        found: dict[bytes, list[int]] = {}
        if not words or not self.sizes:
            return found
        h = word_hashes(words)
        for n in self.sizes:
            grams = gram_hashes(h, n)
            if n == WINDOW:
                at, prints = fingerprints(h)
                at = at[self.passes(prints, 0)]
                near = (at[:, None] - np.arange(WINDOW - K + 1)).ravel()
                starts = np.unique(near[(near >= 0) & (near < len(grams))])
            else:
                starts = np.arange(len(grams))
            for i in starts[self.passes(grams[starts], n)].tolist():
                found.setdefault(b" ".join(words[i : i + n]), []).append(i)
        return found


def sieve(table: DataFrame) -> Sieve:
    """Made by the executors: what comes to the driver is the bitmap, and at most WINDOW lengths."""
    sizes = sorted(r["n"] for r in table.filter("n > 0").select("n").distinct().collect())
    total = table.select("hash").distinct().count()
    bits = min(SIEVE_BITS, max(1 << 16, 1 << (16 * total).bit_length()))
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    cells = table.select(F.shiftright(slot, 6).alias("cell"), one.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return Sieve(out, sizes)


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(s[0]), int(s[1])) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


FOUND = "array<struct<words:string,n:int,starts:array<int>>>"
_FOUND = pa.list_(pa.struct([("words", pa.string()), ("n", pa.int32()), ("starts", pa.list_(pa.int32()))]))


def scan(slim: DataFrame, made: Sieve, kind: str) -> DataFrame:
    """doc_id, digest (MD5 of the text), n_words and the candidates of each document."""
    shared = slim.sparkSession.sparkContext.broadcast(made)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, found, digest = [], [], []
        for text in utf8(batch.column("text")):
            words = words_of(text)
            n_words.append(len(words))
            found.append([{"words": w.decode(), "n": w.count(b" ") + 1, "starts": at} for w, at in shared.value.candidates(words).items()])
            digest.append(hashlib.md5(text or b"").hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digest, pa.string()), pa.array(n_words, pa.int64()), pa.array(found, _FOUND)], names=["doc_id", "digest", "n_words", "found"])

    return map_blocks(slim, "text", run, f"doc_id {kind}, digest string, n_words bigint, found {FOUND}")


def asked(scanned: DataFrame) -> DataFrame:
    """digest, words, n, starts: the candidates of each distinct text."""
    once = scanned.filter(F.size("found") > 0).groupBy("digest").agg(F.first("found").alias("found"))
    return once.select("digest", F.explode("found").alias("f")).select("digest", "f.words", "f.n", "f.starts")


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def _spans(found: pa.Array) -> pa.Array:
    return pa.array([[list(s) for s in merged([(i, i + w["n"]) for w in ws for i in w["starts"]])] for ws in found.to_pylist()], pa.list_(pa.list_(pa.int32())))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: n_words, n_hit, items (sorted array<string>), spans (array of [start, end) in words)."""
    kind = docs.schema[id_col].dataType.simpleString()
    with scratch(docs.sparkSession) as s:
        table = written(windows(key_and_text(benchmark, item_col, item_text).distinct()), "bench-windows")
        scanned = written(scan(key_and_text(docs, id_col, text_col), sieve(table), kind), "doc-windows")
        known = table.filter("n > 0")
        hits = written(asked(scanned).join(known.select("words").distinct(), "words"), "window-hits")
        spans = hits.groupBy("digest").agg(F.collect_list(F.struct("n", "starts")).alias("f")).select("digest", _spans("f").alias("spans"))
        items = hits.select("digest", "words").join(known.select("words", "item"), "words").select("digest", "item").distinct().groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
        told = written(spans.join(items, "digest"), "text-hits")
        out = scanned.select("doc_id", "digest", "n_words").join(told, "digest", "left")
        n_hit = F.expr("aggregate(spans, 0L, (s, x) -> s + x[1] - x[0])")
        empty = lambda c: F.coalesce(c, F.array().cast(dict(told.dtypes)[c]))
        return s.result(out.select(F.col("doc_id").alias(id_col), "n_words", F.coalesce(n_hit, F.lit(0).cast("bigint")).alias("n_hit"), empty("items").alias("items"), empty("spans").alias("spans")), "contamination")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest columns of contamination(): n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark, **options)
    key = options.get("id_col", "doc_id")
    return found.select(key, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any hit, all columns kept; null texts stay. The digests of texts with a hit are a table of
    the shared folder, for the caller's rows are read after this returns."""
    spark = docs.sparkSession
    with scratch(spark) as s:
        table = written(windows(key_and_text(benchmark, item_col, item_text).distinct()), "bench-windows")
        slim = docs.select(F.lit(0).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        scanned = written(scan(slim, sieve(table), "int").filter(F.size("found") > 0).select("digest", "found"), "doc-windows")
        hit = s.result(asked(scanned).join(table.filter("n > 0").select("words").distinct(), "words").select(F.col("digest").alias("hit")).distinct(), "contaminated")
    return docs.alias("d").join(hit.alias("h"), F.md5(F.col(f"d.`{text_col}`").cast("string")) == F.col("h.hit"), "left_anti")

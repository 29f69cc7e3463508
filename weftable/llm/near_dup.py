"""Near-duplicate documents by MinHash: many universal-hash minima, banding, signature verification, exact
confirmation, and connected components by alternating large-star and small-star.

Words are runs of other than ASCII white space after lower-casing A-Z; a document's set is its distinct runs of
SHINGLE words (the whole sequence if it has fewer). Two documents are linked if PERCENT * |union| <= 100 * |both|.

1. One pass over the texts: a 128-bit hash of the word sequence (documents equal in it are one class, whose
   smallest doc_id stands for it) and BANDS keys of ROWS minima each. A pair at the threshold shares no key with a
   chance of (1 - 0.8 ** ROWS) ** BANDS, 4e-7, if the family's minima were independent; a more similar pair even less often.
2. In every bucket of two or more, a member drawn by a hash of the bucket leads. Pairs of leader and member are
   compared by 512 more minima; what may reach the threshold (est >= CUT, 4.5 standard deviations below it) is
   confirmed on the full sets. Components of these links follow.
3. Only pairs of one bucket that lie in different components are still open. They are compared block by block
   (at most BLOCK members against BLOCK), each pair in its first common bucket only: by their sketches, then by
   their whole sets at 32 bits a shingle, which bound the overlap from above. What passes is confirmed likewise,
   and the components taken again. So no bucket's pairs are all emitted, no bucket is collected by one task, and none of
   its pairs goes unseen. The work of this step grows with a bucket's members outside its largest component.

Defined results: doc_ids are integers; texts that are null or have no words have n_shingles 0 and are alone; a null doc_id takes no
part (component_id null, kept true); rows that share a doc_id are each judged by their own text; ties of equal similarity are links
alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftable.llm.common import key_and_text, map_blocks, scratch, utf8, written
from weftable.llm.components import components
from weftable.llm.words import gram_hashes, word_hashes

SHINGLE, PERCENT = 5, 80
ROWS, BANDS = 4, 28
SKETCH, CUT = 512, 0.72
BLOCK = 512
_STEP = 1024  # shingles hashed at once


def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return tuple(r.integers(0, 1 << 64, n, dtype=np.uint64)[:, None] for _ in "ab")


_BANDING, _SKETCHING = _family(ROWS * BANDS, 41), _family(SKETCH, 43)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minima of each hash of a strongly universal family over a set of at least one: the upper halves of a * x + b
    (mod 2**64), x being 32 bits of a shingle's hash (multiply-add-shift)."""
    a, b = family
    x = shingles >> np.uint64(32)
    out = None
    for i in range(0, len(x), _STEP):
        low = (a * x[None, i : i + _STEP] + b).min(1)
        out = low if out is None else np.minimum(out, low)
    return (out >> np.uint64(32)).astype(np.uint32)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """(128-bit hash of the word sequence, sorted distinct shingle hashes)."""
    words = (text or b"").lower().split()
    if not words:
        return b"", np.empty(0, np.uint64)
    return xxhash.xxh3_128_digest(b" ".join(words)), np.unique(gram_hashes(word_hashes(words), min(size, len(words))))


def profile(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, c1, c2 (class), n (set size), bands; no class and no bands without words."""
    salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c1, c2, n, bands, seen = [], [], [], [], {}
        for text in utf8(batch.column("text")):
            digest, x = shingle_set(text, shingle)
            n.append(len(x))
            if not digest:
                c1.append(None)
                c2.append(None)
                bands.append(None)
                continue
            c1.append(int.from_bytes(digest[:8], "big", signed=True))
            c2.append(int.from_bytes(digest[8:], "big", signed=True))
            if digest not in seen:
                m = minima(x, _BANDING).reshape(BANDS, ROWS).astype(np.uint64)
                seen[digest] = (gram_hashes_of(m) ^ salt).view(np.int64)
            bands.append(seen[digest])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "c1", "c2", "n", "bands"])

    return map_blocks(docs, "text", run, "doc_id bigint, c1 bigint, c2 bigint, n bigint, bands array<bigint>")


def gram_hashes_of(m: np.ndarray) -> np.ndarray:
    """One hash for each row of minima."""
    return gram_hashes(m.ravel(), m.shape[1])[:: m.shape[1]]


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """node, n, sketch (the low bytes of SKETCH minima), low (the set's distinct low halves), items (the set)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sketch, low, items = [], [], [], []
        for text in utf8(batch.column("text")):
            _, x = shingle_set(text, shingle)
            n.append(len(x))
            sketch.append(minima(x, _SKETCHING).astype(np.uint8).tobytes() if len(x) else None)
            low.append(np.unique(x.astype(np.uint32)).tobytes())
            items.append(x.view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), pa.array(low, pa.binary()), pa.array(items, pa.list_(pa.int64()))], names=["node", "n", "sketch", "low", "items"])

    return map_blocks(docs, "text", run, "node bigint, n bigint, sketch binary, low binary, items array<bigint>")


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of sketches; equal low bytes by chance are taken off."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def may_reach(a: np.ndarray, na: int, others: list[np.ndarray], nb: np.ndarray) -> np.ndarray:
    """Whether a set can reach the threshold with each of the others. Sets are given by their distinct low halves,
    a and others, and their sizes; shingles that share a low half count as common, so no link is ruled out."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    both = np.add.reduceat((a[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    both += np.minimum(na - len(a), nb - sizes)
    return 100 * both >= PERCENT * (na + nb - both)


def may_link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose set sizes and sketches allow a link."""
    small = sets.select("node", "n", "sketch")
    a = small.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    b = small.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    both = pairs.join(a, "u").join(b, "v").filter(100 * F.least("nu", "nv") >= PERCENT * F.greatest("nu", "nv"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("su", "sv"))
                yield batch.select(["u", "v"]).filter(pa.array(alike(s, t) >= CUT))

    return both.select("u", "v", "su", "sv").mapInArrow(run, "u bigint, v bigint").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links by their full sets."""
    a = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("items").alias("iu"))
    b = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("items").alias("iv"))
    both = pairs.join(b, "v").join(a, "u").withColumn("both", F.size(F.array_intersect("iu", "iv")).cast("bigint"))
    return both.filter(100 * F.col("both") >= PERCENT * (F.col("nu") + F.col("nv") - F.col("both"))).select("u", "v")


def open_pairs(members: DataFrame, label: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(u, v): pairs of one bucket in different components that may be links by their sketches and low halves."""
    m = members.join(label, members.node == label.node, "left").select("band", members.node, F.coalesce("component", members.node).alias("comp")).distinct()
    m = written(m, "bucket-components")
    part = m.groupBy("band", "comp").agg(F.count("*").alias("k"))
    wide = part.groupBy("band").agg(F.max("k").alias("k"), F.sum("k").alias("size"), F.count("*").alias("parts")).filter("parts > 1").select("band", "k", "size")
    main = part.join(wide, ["band", "k"]).groupBy("band").agg(F.min("comp").alias("main"), F.first("size").alias("size"), F.first("k").alias("k"))
    main = written(main.select("band", "main", F.ceil(F.col("size") / BLOCK).alias("ways"), F.ceil((F.col("size") - F.col("k")) / BLOCK).alias("minor_ways")), "open-buckets")
    info = sets.select("node", "n", "sketch", "low").join(reps.select(F.col("doc_id").alias("node"), "bands"), "node")
    rows = m.join(main, "band").join(info, "node")
    salt = F.pmod(F.xxhash64("node"), F.col("ways"))
    left = rows.filter("comp <> main").withColumn("i", F.pmod(F.xxhash64("node"), F.col("minor_ways"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ways") - 1)))
    right = rows.withColumn("j", salt).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("minor_ways") - 1)))
    columns = ["band", "i", "j", "node", "comp", "main", "n", "sketch", "low", "bands"]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        us, vs = [], []
        if a.num_rows and b.num_rows:
            band = a.column("band")[0].as_py()
            an, bn = a.column("node").to_numpy(), b.column("node").to_numpy()
            ac, bc = a.column("comp").to_numpy(), b.column("comp").to_numpy()
            size_a, size_b, main_ = a.column("n").to_numpy(), b.column("n").to_numpy(), a.column("main")[0].as_py()
            sa, sb = (np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH) for t in (a, b))
            ba, bb = (np.array(t.column("bands").to_pylist(), np.int64) for t in (a, b))
            la, lb = ([np.frombuffer(x, np.uint32) for x in t.column("low").to_pylist()] for t in (a, b))
            for i in range(len(an)):
                # a pair of two minor members meets twice, once from each side: the larger node's side counts
                ok = (bc != ac[i]) & ((bc == main_) | (bn < an[i])) & (100 * np.minimum(size_b, size_a[i]) >= PERCENT * np.maximum(size_b, size_a[i]))
                at = np.flatnonzero(ok)
                if len(at):
                    at = at[alike(sb[at], sa[i]) >= CUT]
                if len(at):
                    same = bb[at] == ba[i]
                    at = at[bb[at, same.argmax(1)] == band]  # the first common bucket
                if len(at):
                    at = at[may_reach(la[i], int(size_a[i]), [lb[j] for j in at.tolist()], size_b[at])]
                    us += [an[i]] * len(at)
                    vs += bn[at].tolist()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    key = ["band", "i", "j"]
    return left.select(*columns).groupBy(*key).cogroup(right.select(*columns).toDF(*columns).groupBy(*key)).applyInArrow(compare, "u bigint, v bigint")


def groups(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (it is that one)."""
    with scratch(docs.sparkSession) as s:
        docs = key_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
        profiles = written(profile(docs, shingle), "profiles")
        full = profiles.filter("c1 is not null and doc_id is not null")
        classes = written(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
        chosen = classes.select("c1", "c2", F.col("node").alias("doc_id"))
        reps = written(full.join(chosen, ["c1", "c2", "doc_id"], "left_semi").select("doc_id", "bands"), "representatives")

        rows = reps.select(F.explode("bands").alias("band"), F.col("doc_id").alias("node"))
        turn = F.xxhash64("band")  # draws the leader of each bucket anew
        drawn = F.col("node").bitwiseXOR(turn)
        leaders = rows.groupBy("band").agg(F.min(drawn).alias("low"), F.max(drawn).alias("high")).filter("low <> high")
        leaders = written(leaders.select("band", F.col("low").bitwiseXOR(turn).alias("leader")), "leaders")
        members = written(rows.join(leaders, "band").select("band", "node", "leader"), "members")

        wanted = members.select(F.col("node").alias("doc_id")).distinct()
        sets = written(sets_of(docs.join(wanted, "doc_id", "left_semi"), shingle), "sets")
        pairs = members.filter("node <> leader").select(F.greatest("node", "leader").alias("u"), F.least("node", "leader").alias("v")).distinct()
        links = written(confirmed(written(may_link(pairs, sets), "leader-pairs"), sets), "links")
        label = components(links)
        more = written(confirmed(written(open_pairs(members, label, sets, reps), "open-pairs"), sets), "links")
        if more.limit(1).count():
            label = components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more.select("u", "v")))

        named = classes.join(label, "node", "left").filter("copies > 1 or component is not null").select("c1", "c2", F.coalesce("component", "node").alias("component_id"))
        named = written(named, "class-components")
        out = profiles.join(named, ["c1", "c2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
        out = out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
        return s.result(out, "near-dup")

"""Byte-level BPE encoding and decoding by a rank file.

A pre-token that is no rank itself is merged by a hierarchical-bitmap rank queue: one bucket per merge rank holds
the positions (in a linked list of tokens) of pairs of that rank; three levels of 64-bit words tell which buckets are
filled, so that find-first-set gives the next rank in three steps. A merge leaves the entries of the pairs that it
destroyed behind; they are recognised as stale and skipped. All is in flat lists that outlive a call. The new
pre-tokens of a text lie in one such list side by side, with fences that no pair crosses, so setting up costs little
for short ones, and a pre-token of n bytes costs O(n log n) whatever its pairs are. The queue suits long pre-tokens:
on those of at most SCAN bytes, a scan for the lowest rank before each merge gives the same ids in half the time.

A text is cut by the pattern. For PLAIN, whose matches always end where white space begins, runs up to there are
looked up in a cache first; other patterns' own matches are.

Defined results: null text encodes as empty text (no ids, empty bytes); rows keep their number, so repeated
rows give repeated results; ties in rank go to the leftmost pair; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftable.llm.common import key_and_text, map_blocks

#: The pattern of the public byte-level rank files that PARTS is right for. Fixed value.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as that pattern means it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts a text where PLAIN always ends a match: before white space that follows another character, and after it, the
#: last plain space going with what follows. So each part can be encoded by itself.
PARTS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Bytes of a pre-token up to which a scan finds the next merge; measured, it is faster to about 24 bytes.
SCAN = 16
#: Longer parts, in characters, aren't kept in the cache.
KEPT = 48
#: Entries of a generation of the cache of parts; at most two generations live in a worker.
CACHE = 120_000
#: Parts handled at once, so that the memory for one huge text stays bounded.
PIECES = 1 << 16


#: More than any rank.
NONE = 1 << 62


class RankQueue:
    """Positions in buckets by rank, under a bitmap of three levels; for ranks below `ranks`."""

    __slots__ = ("buckets", "leaf", "mid", "top")

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.leaf = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def mark(self, rank: int) -> None:
        """Tells the bitmap of a bucket that is no longer empty."""
        a, b = rank >> 6, rank >> 12
        self.leaf[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def push(self, rank: int, position: int) -> None:
        if not (bucket := self.buckets[rank]):
            self.mark(rank)
        bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right; None when the queue is empty."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        w = self.mid[b]
        a = b << 6 | (w & -w).bit_length() - 1
        w = self.leaf[a]
        rank = a << 6 | (w & -w).bit_length() - 1
        self.leaf[a] = w & (w - 1)
        if not self.leaf[a]:
            self.mid[b] &= self.mid[b] - 1
            if not self.mid[b]:
                self.top &= self.top - 1
        found, self.buckets[rank] = self.buckets[rank], []
        found.sort()
        return rank, found


class Merges:
    """The merges of a rank file: ids of pre-tokens by the queue. A token's id is the rank that made it."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.name = {i: str(i) for i in ranks.values()}
        self.text = {b: self.name[i] for b, i in ranks.items()}
        self.byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.one = [bytes([b]) for b in range(256)]
        self.pair = [NONE] * (1 << 16)  # of two bytes
        for b, i in ranks.items():
            if len(b) == 2:
                self.pair[b[0] << 8 | b[1]] = i

    def scanned(self, piece: bytes) -> str:
        """Ids of a short pre-token, joined by a space, by scanning for the lowest rank before each merge."""
        get, pair = self.ranks.get, self.pair
        tokens = list(map(self.one.__getitem__, piece))
        rank = [pair[a << 8 | b] for a, b in zip(piece, piece[1:])]
        while rank and (low := min(rank)) != NONE:
            i = rank.index(low)
            del rank[i]
            new = tokens[i] = tokens[i] + tokens.pop(i + 1)
            if i < len(rank):
                rank[i] = get(new + tokens[i + 1], NONE)
            if i:
                rank[i - 1] = get(tokens[i - 1] + new, NONE)
        return " ".join(map(self.text.__getitem__, tokens))

    def ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token, by one run of the queue over all of them."""
        data = b"".join(pieces)
        n, get, pair, queue = len(data), self.ranks.get, self.pair, self.queue
        buckets, mark = queue.buckets, queue.mark
        token, key = list(map(self.byte.__getitem__, data)), [-1] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        fence = bytearray(n + 1)  # 1 where a piece begins
        fence[n] = 1
        i = 0
        for p in pieces:
            fence[i] = 1
            was = p[0]
            for now in p[1:]:
                r = pair[was << 8 | now]
                if r != NONE:
                    key[i] = r
                    if not (bucket := buckets[r]):
                        mark(r)
                    bucket.append(i)
                was = now
                i += 1
            i += 1
        while (found := queue.pop()) is not None:
            r, places = found
            for nth, i in enumerate(places):
                if key[i] != r:
                    continue  # stale
                token[i] = r
                j = after[i]
                k = after[i] = after[j]
                key[j] = s = t = -1
                if not fence[k]:
                    before[k] = i
                    if (s := get(data[i : after[k]], -1)) >= 0:
                        if not (bucket := buckets[s]):
                            mark(s)
                        bucket.append(i)
                key[i] = s
                if not fence[i]:
                    h = before[i]
                    key[h] = t = get(data[h:k], -1)
                    if t >= 0:
                        if not (bucket := buckets[t]):
                            mark(t)
                        bucket.append(h)
                if 0 <= s < r or 0 <= t < r:  # a lower rank has come up: it goes first
                    for p in places[nth + 1 :]:
                        queue.push(r, p)
                    break
        out, i = [], 0
        for p in pieces:
            ids, end = [], i + len(p)
            while i < end:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out


class Codec:
    """Encoder and decoder of one rank file; one per worker process."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {str(i): b for b, i in self.ranks.items()}
        self.merges = Merges(self.ranks)
        self.pattern = regex.compile(pattern)
        self.plain = pattern == PLAIN
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def runs(self, text: str):
        """The ids of a whole text as strings of decimal ids joined by a space, a bounded run of parts at a time."""
        if self.plain and len(text) <= 4 * PIECES:
            if pieces := PARTS.findall(text):
                yield self.joined(pieces)
            return
        found = (m.group() for m in (PARTS if self.plain else self.pattern).finditer(text))
        while pieces := [p for p in islice(found, PIECES) if p]:
            yield self.joined(pieces)

    def joined(self, pieces: list[str]) -> str:
        young = self.young
        ids = list(map(young.get, pieces))
        if missed := [i for i, x in enumerate(ids) if x is None]:
            new = {pieces[i] for i in missed}
            got = {p: self.old[p] for p in new if p in self.old}
            got |= self.encoded(new - got.keys())  # with their pre-tokens
            for i in missed:
                ids[i] = got[pieces[i]]
            if len(young) >= CACHE:
                self.old, self.young = young, {}
            self.young |= {p: x for p, x in got.items() if len(p) <= KEPT}
        return " ".join(ids)

    def encoded(self, parts: set[str]) -> dict[str, str]:
        """Ids of parts that no cache holds; those of their long pre-tokens that are no rank go through the queue together."""
        out, cut, get, name, scanned = {}, {}, self.merges.text.get, self.merges.name, self.merges.scanned
        if self.plain:  # a part of ASCII letters is one pre-token
            cut = {p: self.pattern.findall(p) for p in parts if not (p.isascii() and (p.isalpha() or (p[0] == " " and p[1:].isalpha())))}
            parts = (parts - cut.keys()) | {x for xs in cut.values() for x in xs}
            for known in (self.old, self.young):  # a pre-token may have been a part before
                out |= {p: known[p] for p in parts & known.keys()}
            parts -= out.keys()
        hard, whose = [], []
        for p in parts:
            b = p.encode()
            known = get(b)
            if known is not None:
                out[p] = known
            elif len(b) <= SCAN:
                out[p] = scanned(b)
            else:
                hard.append(b)
                whose.append(p)
        for p, ids in zip(whose, self.merges.ids(hard) if hard else ()):
            out[p] = " ".join([name[i] for i in ids])
        for p, xs in cut.items():
            out[p] = " ".join([out[x] for x in xs])
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        ids = [[int(x) for run in c.runs(t or "") for x in run.split(" ")] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_blocks(key_and_text(df, id_col, text_col), "text", run, f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of rows of ids; null ids give empty bytes. An id outside the rank file is an error."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path, "")
        for b in batches:
            out = [b"".join(c.bytes_of[str(x)] for x in ids or ()) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    from pyspark.sql import functions as F

    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return slim.mapInArrow(run, f"doc_id {kind}, decoded binary").withColumnRenamed("doc_id", id_col)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, SHA-256 of the ids joined by a space, SHA-256 of the bytes decoded from these ids."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        n, coded, plain = [], [], []
        for text in batch.column("text").to_pylist():
            count, a, b = 0, hashlib.sha256(), hashlib.sha256()
            for ids in c.runs(text or ""):
                a.update((" " + ids if count else ids).encode())
                b.update(c.decode(ids))
                count += ids.count(" ") + 1
            n.append(count)
            coded.append(a.hexdigest())
            plain.append(b.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_blocks(key_and_text(df, id_col, text_col), "text", run, schema).withColumnRenamed("doc_id", id_col)

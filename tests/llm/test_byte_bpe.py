from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftable.llm import byte_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(ids):
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def check(got, rows, library):
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), digest(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_the_tables(docs, texts, library):
    check(B.digests(docs, PATH, P.PATTERN), texts, library)


def test_odd_rows(odd, empty, library):
    check(B.digests(odd, PATH, P.PATTERN), [(r["doc_id"], r["text"]) for r in odd.collect()], library)
    assert B.digests(empty, PATH, P.PATTERN).count() == 0


def test_encode_and_decode(odd, library):
    ids = B.encode(odd, PATH, P.PATTERN)
    want = sorted((str(r["doc_id"]), library.encode_ordinary(r["text"] or "")) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in ids.collect()) == want
    back = B.decode(ids, PATH)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in back.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())


@given(st.lists(st.binary(min_size=1, max_size=60), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_both_ways_of_merging(pieces):
    c = B.codec(PATH, P.PATTERN)
    assert [" ".join(map(str, ids)) for ids in c.merges.ids(pieces)] == [c.merges.scanned(p) for p in pieces]


def test_every_pre_token_by_the_queue(texts, library, monkeypatch):
    """The whole table with no scan at all; and with it, some of its pre-tokens still reach the queue."""
    asked, ids = [], B.Merges.ids
    monkeypatch.setattr(B.Merges, "ids", lambda self, pieces: asked.extend(pieces) or ids(self, pieces))
    for scan in (0, B.SCAN):
        monkeypatch.setattr(B, "SCAN", scan)
        asked.clear()
        c = B.Codec(PATH, P.PATTERN)
        for _, t in texts:
            assert [int(x) for run in c.runs(t or "") for x in run.split(" ")] == library.encode_ordinary(t or "")
        assert len(asked) > (1000 if not scan else 10)


def test_ranks_that_fall_below_the_one_just_merged():
    """A merge that makes a pair of a lower rank: that one goes first, before others of the same rank."""
    names = [b"a", b"b", b"c", b"d", b"abc", b"bcd", b"ab", b"bc", b"cd", b"abcd", b"dab", b"cdab"]
    rng = random.Random(2)
    for _ in range(300):
        order = names[:4] + rng.sample(names[4:], 8)
        ranks = {x: i for i, x in enumerate(order)}
        pieces = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 30))) for _ in range(4)]
        merges = B.Merges(ranks)
        assert [" ".join(map(str, ids)) for ids in merges.ids(pieces)] == [merges.scanned(p) for p in pieces]


def test_another_pattern(spark, library):
    """A pattern that joins a tab to the word after it: the text is cut by it alone."""
    pattern = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    text = "\tfoo();\n\n  bar\u00e9 12345\t\tx\n"
    got = B.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, pattern).first()["ids"]
    assert got == other.encode_ordinary(text)


@given(st.text(alphabet=st.sampled_from("ab1 \n\t'sé  \x85\x1c😀.-"), max_size=80))
@settings(max_examples=500, deadline=None)
def test_parts_are_encoded_by_themselves(library, text):
    c = B.codec(PATH, P.PATTERN)
    assert [int(x) for run in c.runs(text) for x in run.split(" ")] == library.encode_ordinary(text)


def test_very_long_pre_tokens(library):
    rng = random.Random(3)
    c = B.codec(PATH, P.PATTERN)
    for text in ("a" * 100_000, "".join(rng.choice("abcdefgh") for _ in range(100_000)), "ab" * 50_000 + "é" * 20_000, " " * 30_000):
        assert [int(x) for run in c.runs(text) for x in run.split(" ")] == library.encode_ordinary(text)


def test_rank_queue():
    rng = random.Random(4)
    q, ref = B.RankQueue(1 << 17), {}
    for _ in range(5000):
        if rng.random() < 0.8:
            rank, at = rng.randrange(1 << 17) >> rng.randrange(17), rng.randrange(1000)
            q.push(rank, at)
            ref.setdefault(rank, []).append(at)
        elif ref:
            low = min(ref)
            assert q.pop() == (low, sorted(ref.pop(low)))
    while ref:
        low = min(ref)
        assert q.pop() == (low, sorted(ref.pop(low)))
    assert q.pop() is None

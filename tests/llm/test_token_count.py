from __future__ import annotations

import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftable.llm import token_count as C

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_the_tables(docs, texts, plain):
    want = {i: (len((t or "").encode()), len(plain(t or ""))) for i, t in texts}
    got = C.token_counts(docs, PATH)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got.collect()} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got.collect())


@pytest.mark.parametrize("path", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files(odd, empty, path):
    t = C.tokenizer(P.path(path))
    size = (lambda x: len(t.encode(x))) if path.endswith(".model") else (lambda x: len(t.encode(x, add_special_tokens=False)))
    got = C.token_counts(odd, P.path(path)).collect()
    want = sorted((str(r["doc_id"]), size(r["text"] or "")) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want
    assert C.token_counts(empty, P.path(path)).count() == 0


@given(st.text(alphabet=st.sampled_from("aB1 '\n\tst.é😀  <|endoftext|>"), max_size=600), st.integers(24, 80))
@settings(max_examples=150, deadline=None)
def test_splicing_gives_the_whole(plain, text, chunk):
    assert C.spliced(C.tokenizer(PATH), text, chunk, 20) == plain(text)


def test_splicing_of_long_texts(plain):
    rng = random.Random(2)
    t = C.tokenizer(PATH)
    cases = ["a" * 9000, " " * 9000, "x1" * 5000, "\n" * 3000 + "b", "".join(rng.choice("ab \n'123é<|endoftext|>") for _ in range(20_000)), "<|endoftext|>" * 700, ("word " * 300 + "z" * 3000) * 3]
    for text in cases:
        assert C.spliced(t, text, 512, 64) == plain(text)

"""Token counts of whole texts as a tokenizer file's own library gives them.

Texts of at most `chunk` characters are encoded whole. Longer ones are encoded in overlapping chunks with
offsets, and neighbouring chunks are spliced at a boundary that both have. Which boundaries are safe:

* A chunk whose start is a boundary of the whole text scans as the whole text does, until the end of the
  chunk comes into the pre-tokenizer's sight. A pre-token's end is decided by its own characters and the
  few after it, so every pre-token boundary at least `guard` characters before the chunk's end is a
  boundary of the whole text (guard exceeds the longest lookahead and the longest added token).
* A later chunk may start anywhere. From the first position on at which it has a pre-token boundary that
  the earlier chunk has shown to be one of the whole text, it scans as the whole text does.

Tokens never cross pre-tokens, so the earlier chunk's tokens before such a common boundary and the later
chunk's from there on are exactly those of the whole text. Where an overlap holds no common boundary (one
enormous word, say), the overlap is widened by doubling, up to the whole rest of the text.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; an
empty table gives an empty table.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame

from weftable.llm.common import key_and_text, map_blocks, utf8

CHUNK = 1 << 15
OVERLAP = 1 << 9
GUARD = 16

_loaded: dict[str, object] = {}
_splices: dict[str, bool] = {}


def tokenizer(path: str):
    """The library's tokenizer for a .json or .model file; one per worker process, on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = t
    return _loaded[path]


def guard_of(t) -> int:
    return max([GUARD, *(len(a.content) + 1 for a in t.get_added_tokens_decoder().values())])


def bounds(encoding, start: int) -> dict[int, int]:
    """Position in the text of each pre-token's start -> index of its first token. Offsets of byte-level
    pieces of one character overlap, but a pre-token's first token starts where the pre-token does."""
    out, last = {}, None
    for i, (word, (a, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != last:
            out[start + a] = i
            last = word
    return out


def spliced(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a whole text from overlapping chunks."""
    guard, n, ids = guard_of(t), len(text), []
    start, end = 0, min(chunk, len(text))
    now = t.encode(text[start:end], add_special_tokens=False)
    skip = 0  # tokens of `now` that an earlier chunk has given
    while end < n:
        have, wide = bounds(now, start), overlap
        while True:
            begin = max(start, end - wide)
            more_end = min(n, begin + max(chunk, 2 * wide))
            more = t.encode(text[begin:more_end], add_special_tokens=False)
            there = bounds(more, begin)
            # a boundary at the later chunk's own start is a cut and no evidence of its scan, but a true one all the same
            common = max((p for p in there if p in have and have[p] >= skip and p <= end - guard), default=None)
            if common is not None and (common > start or begin > start):
                ids += now.ids[skip : have[common]]
                now, start, end, skip = more, begin, more_end, there[common]
                break
            if begin == start:  # the chunk holds no safe boundary: let it grow
                end = min(n, start + 2 * (end - start))
                now = t.encode(text[start:end], add_special_tokens=False)
                have, wide = bounds(now, start), overlap
                if end == n:
                    break
            else:
                wide *= 2
    return ids + now.ids[skip:]


def count_texts(path: str, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    t = tokenizer(path)
    if path not in _splices:
        _splices[path] = not path.endswith(".model") and can_splice(t)
    if path.endswith(".model"):  # sentencepiece normalises across the text, so no boundary is provably stable: whole texts
        return [len(x) for x in t.encode(texts, num_threads=1)]
    short = [i for i, x in enumerate(texts) if len(x) <= chunk]
    counts = [0] * len(texts)
    for i, e in zip(short, t.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):
        counts[i] = len(e)
    split = _splices[path]
    for i, x in enumerate(texts):
        if len(x) > chunk:
            counts[i] = len(spliced(t, x, chunk, overlap)) if split else len(t.encode(x, add_special_tokens=False))
    return counts


def can_splice(t) -> bool:
    """The proof above is for the byte-level pre-tokenizer alone, without a normalizer and a prefixed space."""
    import json

    spec = json.loads(t.to_str())
    pre = spec["pre_tokenizer"] or {}
    plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in spec["added_tokens"])
    return plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(x or b"") for x in utf8(batch.column("text"))]
        counts = count_texts(path, [x or "" for x in batch.column("text").to_pylist()], chunk, overlap)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_blocks(key_and_text(df, id_col, text_col), "text", run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("doc_id", id_col)

"""The pipeline against brute-force versions of its stages, and the queries against what they must return."""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import key
from tests.llm.test_near_dup import brute as near
from weftable.llm import lang_id


def test_run(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = lang_id.train(docs, ~lang_id.held_out())
    known = {r["doc_id"] for r in lang_id.classify(docs, model).filter("lang_pred <> 'und'").collect()}
    rows = {i: t for i, t in rows.items() if i in known}
    where: dict[str, int] = {}
    for t in rows.values():
        for k in {key(x) for x in t.split("\n")} - {""}:
            where[k] = where.get(k, 0) + 1
    rows = {i: "\n".join(x for x in t.split("\n") if where.get(key(x), 0) < 10) for i, t in rows.items()}
    rows = {i: rows[i] for i, _, _, kept in near_five(rows) if kept}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    rows = {r[0]: rows[r[0]] for r in contaminated(list(rows.items()), [(r["item_id"], r["text"]) for r in bench]) if not r[5]}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows.items():
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert 0 < len(want) < docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def near_five(rows):
    return near(list(rows.items()), corpus_pipeline.SHINGLE)


def test_stages_keep_columns(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.dtypes == df.dtypes
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()


def test_stages_on_odd_rows(spark, odd):
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    everyone = ids(odd)
    stage = {n: (lambda df, f=f: f(spark, df, SF)) for n, f in corpus_pipeline.STAGES}
    assert ids(stage["language_id"](odd)) == sorted([4, 5, 7, 7, None, 10], key=str)
    lines = stage["line_dedup"](odd)
    assert ids(lines) == everyone and {r["doc_id"]: r["text"] for r in lines.collect()}[1] is None
    near_ = stage["near_dedup"](odd)
    assert ids(near_) == sorted([1, 2, 3, 4, 6, 7, None, 8, 9, 10], key=str)
    assert ids(stage["near_dedup"](odd.union(odd.filter("doc_id is null")))) == ids(near_)
    assert ids(stage["decontamination"](odd)) == everyone
    assert {r["doc_id"]: r["n_tokens"] for r in stage["byte_bpe"](odd).collect()}[1] == 0


def test_no_table_is_left_but_the_last(spark, tmp_path):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(root.iterdir())
    entry.queries()["op4_minhash"](spark, SF).count()
    entry.queries()["op8_line_dedup"](spark, SF).count()
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before) == ["line-dedup", "near-dup"]


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in entry.queries()

"""The corpus queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftable.llm import ann, byte_bpe, decontaminate, lang_id, line_dedup, near_dup, pii, secret_scan, token_count, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), threshold=10, min_chars=1)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.report(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"), min_payload=0)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.report(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents"), shingle=4)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_minhash": op4_minhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_pii": op7_pii,
    "op8_line_dedup": op8_line_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_language_id": op10_language_id,
}

#: Words of the contract's class, A-Z lower-cased.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = f"""
with items as (select distinct coalesce(cast(item_id as varchar), 'null') as item, {_WORDS.format('text')} as w from benchmark where text is not null),
sized as (select item, w, least(10, len(w)) as n from items where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as i from sized)),
docs as (select doc_id, row_number() over () as r, coalesce({_WORDS.format('text')}, []) as w from documents),
grams as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as g from
  (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs cross join (select distinct n from windows) where len(w) >= n)),
found as (select r, i, n, item from grams join windows using (n, g)),
hits as (select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + n)) as place from (select distinct r, i, n from found)) group by r),
names as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from found group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from docs left join hits using (r) left join names using (r)
"""

ORACLES["op2_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first_id from p),
b32 as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast(concat('0x', substr(h, cast(5 * (i // 4) + 1 as integer), 5)) as bigint) >> (15 - 5 * (i % 4))) & 31) + 1, 1), '' order by i) as d
  from (select distinct h from p) cross join (select unnest(range(32)) as i) group by h)
select page_id, cast(octet_length(payload) as bigint) as payload_bytes, d as payload_digest, if(page_id = first_id, 'response', 'revisit') as record_type, nullif(first_id, page_id) as refers_to
from f join b32 using (h)
"""

ORACLES["op4_minhash"] = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, hash(g) as a, md5_number(g) as b from (select doc_id, array_to_string(w[i:i + 3], ' ') as g from
  (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0))),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select x.doc_id as u, y.doc_id as v, count(*) as c from s x join s y on x.a = y.a and x.b = y.b and x.doc_id < y.doc_id group by all),
links as (select u, v from pairs join n a on a.doc_id = u join n b on b.doc_id = v where 100 * c >= 80 * (a.n + b.n - c)),
edges as (select u, v from links union all select v, u from links),
reach as (select doc_id, doc_id as node from documents union select reach.doc_id, edges.v from reach join edges on edges.u = reach.node),
least_ as (select doc_id, min(node) as component_id from reach group by doc_id)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id = component_id as kept from least_ left join n using (doc_id)
"""

ORACLES["op8_line_dedup"] = f"""
with rows as (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select doc_id, r, i, line, regexp_replace(regexp_replace({_LOWER.format('line')}, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '') as k
  from (select doc_id, r, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from rows)),
hot as (select k from lines where k <> '' group by k having count(distinct r) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where hot.k is not null) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where hot.k is null), '')) as kept_sha256
from lines left join hot on lines.k = hot.k group by doc_id, r
"""

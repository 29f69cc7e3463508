"""DuckDB SQL for queries.py, from the tables themselves: none of it parses the HTML that those queries render."""

from __future__ import annotations

#: Customers with the article and the row that they are rendered in.
_CUSTOMERS = "b as (select *, c_custkey // 40 as article, cast(row_number() over (partition by c_custkey // 40 order by c_custkey) - 1 as integer) as r from customer)"
#: Cells of the first and second column of orders, by the sub-table that they are rendered in.
_ORDERS = """b as (select *, o_orderkey // 40 as article, cast(o_orderkey % 2 as integer) as table_ord, cast(case when o_orderkey % 4 = 2 then 1 else 0 end as integer) as sub_id from orders),
cells as (select article, table_ord, sub_id, if(sub_id = 1, 'Later', 'Priority') as name, o_orderpriority as value from b
  union all select article, table_ord, sub_id, if(sub_id = 1, 'Later', 'Link'), case o_orderkey % 3 when 0 then o_orderpriority when 1 then '' else concat('see ', o_orderstatus) end from b)"""


def _unpivot(*columns: tuple[int, str, str], keys: str = "article, r as row_index", source: str = "b", more: dict[int, str] | None = None) -> str:
    """A row for each (col_index, column name, value in SQL)."""
    extra = more or {}
    return " union all ".join(f"select {keys}, {i} as col_index, {name} as \"column\", cast({value} as varchar) as value{extra.get(i, '')} from {source}" for i, name, value in columns)


_PLAIN = _unpivot((0, "'Key'", "c_custkey"), (1, "'Name'", "c_name"), (2, "'Segment'", "c_mktsegment"))
#: Leaf columns of both tables of an article, by place.
_DOUBLED = """with b as (select distinct c_custkey // 40 as article from customer),
leaf as (select article, 0 as table_ord, i as col_index, n as name from b cross join (values (0, 'Name'), (1, 'Segment'), (2, 'Name')) as v(i, n)
  union all select article, 1, cast(i + article % 2 as integer), n from b cross join (values (-1, 'Key'), (0, 'Segment'), (1, 'Name')) as v(i, n) where i + article % 2 >= 0)"""
#: The cells of these tables that a map of a row keeps.
_DOUBLED_CELLS = """select article, 0 as table_ord, r as row_index, 'Name' as "column", cast(c_custkey as varchar) as value from b
union all select article, 0, r, 'Segment', c_mktsegment from b union all select article, 1, r, 'Segment', c_mktsegment from b
union all select article, 1, r, 'Name', c_name from b union all select article, 1, r, 'Key', cast(c_custkey as varchar) from b where article % 2 = 1"""

#: The first column's cell covers its nation's rows; in later rows of a nation the first cell takes column 0's name.
_SPANNED = """with b as (select *, c_custkey // 40 as article,
  cast(row_number() over (partition by c_custkey // 40 order by c_nationkey, c_custkey) - 1 as integer) as r,
  row_number() over (partition by c_custkey // 40, c_nationkey order by c_custkey) as nth from customer)
select article, r as row_index, 0 as col_index, 'Nation' as "column", cast(c_nationkey as varchar) as value, 'Nation' as column_at_index from b
union all select article, r, 1, {}, c_name, 'Name' from b
union all select article, r, 2, 'Segment', c_mktsegment, 'Segment' from b"""

_LINES = "lines as (select doc_id, regexp_replace(regexp_replace(l[i], '^\\s+', ''), '\\s+$', '') as line, i - 1 as pos, len(l) as n from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents)))"
_BUCKETS = "buckets as (select *, case when n = 1 or pos < 1 then -1 else cast(floor((pos - 1) * 9.0 / (n - 1)) as integer) end as bucket from lines)"
_TOKENS = """tokens as (select doc_id, bucket, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(line, '!+|\\|+|-', chr(9), 'g'), '^\\s+', ''), '\\s+$', ''), chr(9))) as token
  from buckets where not regexp_matches(line, '^\\{\\|\\s?class=') and not starts_with(line, '|+') and line <> ''),
kept as (select *, token in ('the', 'license', '', 'und') as known from tokens where token <> '' and not contains('the lines of it', token)
  and not regexp_matches(token, '^(colspan|rowspan|bgcolor|style|class)')),
coverage as (select doc_id, bucket, token, count(*) filter (where known) as covered, count(*) filter (where not known) as uncovered from kept group by all)"""
_COVERAGE = f"with {_LINES}, {_BUCKETS}, {_TOKENS}"
_FEATURES = "select doc_id, concat(bucket, '-', case when covered > 0 then 9 else 0 end) as feature, cast(count(*) as double) as value from coverage group by all"


def _clean(c: str) -> str:
    """The chain of substitutions on markup."""
    for pattern, by in (('\\\\"', '"'), ('style="?(.*?)"', " "), ('(\\\\n)|(class="?wikitable"?)|(colspan=(.*?))|(rowspan=(.*?))|\\|+', " "), ("<ref(\\s?name=(.*?))?>(.*?)</ref>", " "), ("</?span\\s*>", ""), ('(bgcolor="(.*?)")|(align="(.*?)")', " "), ("\\]+|\\[+|\"+|''+|!+|\\}+|\\{+|\\n+|\\++", " "), ("^\\s+", ""), ("\\s+$", "")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


def _divergence(key: str, source: str, a: str, b: str) -> str:
    """CTEs of the divergence of the words of a from those of b; the last one is kl(key, kl)."""
    words = lambda c: f"select {key}, unnest(string_split(lower({c}), ' ')) as w from {source}"
    return f"""ha as ({words(a)}), hb as ({words(b)}),
ca as (select {key}, w, count(*) as c from ha group by all), cb as (select {key}, w, count(*) as c from hb group by all),
na as (select {key}, count(*) as n from ha group by all), nb as (select {key}, count(*) as n from hb group by all),
u as (select coalesce(ca.{key}, cb.{key}) as {key}, coalesce(ca.c, 0.001e0) as a, coalesce(cb.c, 0.001e0) as b from ca full join cb on ca.{key} = cb.{key} and ca.w = cb.w),
kl as (select u.{key}, sum((a / na.n) * ln((a / na.n) / (b / nb.n))) as kl from u join na on u.{key} = na.{key} join nb on u.{key} = nb.{key} group by all)"""


_TAGLESS = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
_JACCARD = "len(list_intersect({0}, {1})) / cast(len(list_distinct(list_concat({0}, {1}))) as double)"
_STRIPPED_TEXT = "regexp_replace(text, '<[^>]+>', ' ', 'g')"
_VALUE_COUNTS = "select article, table_ord, sub_id, {} value, cast(count(*) as integer) as count from cells where {} group by all"
_LETTERS = "case when regexp_full_match(c, '\\p{L}+') then 'lt' when regexp_full_match(c, '\\p{Nd}+') then 'num' else 'ot' end"
#: Sub-tables by segment, and an empty last one.
_INHERITED = """with g as (select c_custkey // 40 as article, c_mktsegment as name, cast(count(*) as integer) as n from customer group by all),
b as (select *, cast(row_number() over (partition by article order by name) - 1 as integer) as s from g)
select article, s as sub_id, n as n_rows, 2 as n_levels, 'Customer|Customer' as top, {0} as leaf from b
union all select article, cast(max(s) + 1 as integer), 0, 2, 'Customer|Customer', {1} from b group by article"""
_JSON = """concat('{{"caption":"","markup":"","id":', n_nationkey, ',"header":[{{"level":0,"columns":[{{"name":"Name","col_span":1,"row_span":1,"value_dist":[{{"value":"', {0}, '","count":1}}]}},{{"name":"Link","col_span":1,"row_span":1,"value_dist":[{{"value":"', n_name,
  '","count":1}}]}}]}}],"rows":[{{"row_index":0,"values":[{{"column":"Name","col_index":0,"value":"', {0}, '"}},{{"column":"Link","col_index":1,"value":"see","structured_values":[{{"structured":"', n_name, '","anchor":"see"}}]}}]}}]}}')"""
_ODD = """concat('\\"', n_name, '\\" \\\\ {}')"""

ORACLES: dict[str, str] = {
    # HTML text
    "html_title": f"select page_id, replace(trim(regexp_replace(replace({_TITLE}, '&amp;', '&'), '\\s+', ' ', 'g')), ' ', '_') as entity from pages",
    "strip_comments": "select page_id, md5(regexp_replace(html, '<!--(.*?)-->', '', 'g')) as digest from pages",
    "strip_tags": f"select page_id, md5({_TAGLESS}) as digest from pages",
    "escape_newlines": "select page_id, md5(replace(html, chr(10), '\\n')) as digest from pages",
    "crawl_lines": "select url as source_entity, md5(concat(chr(9), replace(regexp_replace(html, '<!--(.*?)-->', '', 'g'), chr(10), '\\n'))) as digest from pages",
    "page_link_texts": """select page_id, '' as structured, replace(anchor, '&amp;', '&') as anchor, count(*) as n from
        (select page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as anchor from pages) group by all""",
    "pages_without_tables": "select page_id, 0 as n_sections, 0 as n_errors from pages",
    "seed_distinct": "select distinct p_brand as entity, concat('https://en.wikipedia.org/api/rest_v1/page/html/', replace(replace(p_brand, ' ', '_'), '#', '%23')) as url from part",
    # sections and tables
    "section_names": """with r as (select * from region where r_regionkey in (select n_regionkey from nation))
        select r_regionkey, replace(r_name, ' ', '_') as entity, 0 as section_ord, 'MAIN_SECTION' as section, 1 as n_tables from r
        union all select r_regionkey, replace(r_name, ' ', '_'), 1, r_name, cast(count(*) as integer) from r join nation on r_regionkey = n_regionkey group by r_regionkey, r_name
        union all select r_regionkey, replace(r_name, ' ', '_'), cast(1 + row_number() over (partition by r_regionkey order by n_nationkey) as integer), n_name, 1 from r join nation on r_regionkey = n_regionkey""",
    "table_ids": "with a as (select distinct c_custkey // 40 as article from customer) select cast(5000000 + row_number() over (order by article) as bigint) as table_id, article, 'Rows' as section, 0 as table_ord, 0 as sub_id from a",
    "skip_nested": "select c_custkey // 40 as article, case when c_custkey // 40 % 3 = 0 then 1 else 0 end as table_ord, cast(count(*) as integer) as n_rows from customer group by all",
    "bad_tables": """select distinct a as article, concat('Article_', a) as entity, 'Rows' as section, 0 as table_ord, case when a % 7 = 0 then 'more cells than columns' else 'colspan is no integer: ''2;''' end as reason
        from (select c_custkey // 40 as a from customer) where a % 7 < 2""",
    "table_counts": "select count(*) as n_articles, count(*) filter (where a % 7 <> 0) as n_tables, count(*) filter (where a % 7 = 0) as n_errors from (select distinct c_custkey // 40 as a from customer)",
    # headers, grids and sub-tables
    "cells_plain": f"with {_CUSTOMERS} {_PLAIN}",
    "headers_multilevel": """with s as (select o_orderstatus as article, cast(count(distinct o_orderpriority) as integer) as p, cast(count(distinct n) as integer) as c, cast(count(distinct top) as integer) as t
          from (select o_orderstatus, o_orderpriority, count(*) as n, max(o_orderkey) as top from orders group by all) group by all)
        select article, l as level, i as col_index, n as name, w as col_span, h as row_span, case n when 'Priority' then p when 'Count' then c when 'Largest' then t else 0 end as n_values
        from s cross join (values (0, 0, 'Priority', 1, 2), (0, 1, 'Orders', 2, 1), (0, 2, 'Orders', 2, 1), (1, 0, 'Priority', 1, 2), (1, 1, 'Count', 1, 1), (1, 2, 'Largest', 1, 1)) as v(l, i, n, w, h)""",
    "header_columns": "select distinct o_orderstatus as article, name, cast(1 as bigint) as n_objects, cast(n as bigint) as n_slots from orders cross join (values ('Priority', 2), ('Orders', 2), ('Count', 1), ('Largest', 1)) as v(name, n)",
    "cells_rowspan": _SPANNED.format("case when nth = 1 then 'Name' else 'Nation' end"),
    "cells_rowspan_corrected": _SPANNED.format("'Name'"),
    "cells_colspan": f"""with {_CUSTOMERS} select article, r as row_index, 0 as col_index, 'Name' as "column", c_name as value, 'Name' as column_at_index from b
        union all select article, r, 1, 'Name', c_name, 'Alias' from b union all select article, r, 2, 'Segment', c_mktsegment, 'Segment' from b""",
    "header_fallback": f"""with {_CUSTOMERS}, x as ({_PLAIN}) select article, cast(row_index + 1 as integer) as row_index, col_index, "column", value from x
        union all select distinct article, 0, col_index, "column", "column" from x""",
    "subtables": """with b as (select *, c_custkey // 40 as article, dense_rank() over (partition by c_custkey // 40 order by c_mktsegment) - 1 as s,
          cast(row_number() over (partition by c_custkey // 40, c_mktsegment order by c_custkey) - 1 as integer) as r from customer)
        select article, cast(s as integer) as sub_id, r as row_index, 0 as col_index, case when s = 0 then 'Name' else c_mktsegment end as "column", c_name as value from b
        union all select article, cast(s as integer), r, 1, case when s = 0 then 'Nation' else c_mktsegment end, cast(c_nationkey as varchar) from b""",
    "subtable_segmentation": """select event_id, user_id, cast(sum(b) over (partition by user_id order by ts, event_id) as integer) as sub_id from (
        select *, case when event_type = 'signup' and lag(event_type) over (partition by user_id order by ts, event_id) <> 'signup' then 1 else 0 end as b from events where event_type is not null)""",
    "find_column": f"{_DOUBLED} select article, table_ord, name, min(col_index) as col_index from leaf where name <> 'Key' group by all",
    "num_columns": f"{_DOUBLED} select article, table_ord, cast(count(*) as integer) as num_columns from leaf group by all",
    "header_inheritance": _INHERITED.format("case when s = 0 then 'Name|Nation' else concat(name, '|', name) end", "'End|End'"),
    "header_inheritance_corrected": _INHERITED.format("'Name|Nation'", "'Name|Nation'"),
    "captions_markup": """with b as (select *, c_custkey // 40 as article from customer)
        select article, concat('Customers of & ', article) as caption, md5(concat('<table class="wikitable"><caption>Customers  of &amp; ', article, '</caption><tr><th>Name</th><th>Segment</th></tr>',
          string_agg(concat('<tr><td title="x &amp; y">', c_name, '</td><td>&lt;', c_mktsegment, '&gt;</td></tr>'), '' order by c_custkey), '</table>')) as digest from b group by article""",
    # histograms, links, rows as maps
    "value_dist": f"with {_ORDERS} {_VALUE_COUNTS.format('name,', "name <> 'Link'")}",
    "value_dist_links": f"with {_ORDERS} {_VALUE_COUNTS.format('name as "column",', 'true')}",
    "value_dist_sorted": f"with {_ORDERS}, h as ({_VALUE_COUNTS.format('', "name = 'Priority'")}) select *, cast(row_number() over (partition by article, table_ord, sub_id order by count desc, value) as integer) as rank from h",
    "cell_links": f"with {_ORDERS} select article, table_ord, sub_id, case o_orderkey % 3 when 0 then o_orderpriority else '' end as structured, concat('see ', o_orderstatus) as anchor, count(*) as n from b where o_orderkey % 3 < 2 group by all",
    "row_dict": f"with {_CUSTOMERS} {_DOUBLED_CELLS}",
    "ordered_columns": f"""{_DOUBLED} select article, table_ord, col_index as pos, name as "column" from leaf where table_ord = 1 or col_index < 2""",
    "column_meta": f"""with {_CUSTOMERS}, c as ({_DOUBLED_CELLS}) select distinct article, table_ord, "column", value from c""",
    # JSON and text forms
    "json_roundtrip": f"with {_CUSTOMERS} {_PLAIN}",
    "json_pruned": """with b as (select distinct c_custkey // 40 as article from customer) select article, 1 as id, i as pos, n as "column" from b cross join (values (0, 'Key'), (1, 'Name'), (2, 'Segment')) as v(i, n)""",
    "json_resolved": f"with {_CUSTOMERS}, x as ({_PLAIN}) select article, row_index, col_index as slot, col_index, \"column\", value from x",
    "article_json": "with a as (select c_custkey // 40 as article, cast(count(*) as integer) as n_rows from customer group by all) select concat('Article_', article) as entity, 'Rows' as section, cast(5000000 + row_number() over (order by article) as integer) as table_id, n_rows from a",
    "article_json_file": f"with {_CUSTOMERS} select concat('Article_', article) as entity, 'Rows' as section, r as row_index, concat_ws('|', c_custkey, c_name, c_mktsegment) as row_values from b",
    "table_json_file": "select 'Customers' as entity, 'Rows' as section, c_custkey // 40 as table_id, 'Key|Name|Segment' as columns, cast(count(*) as integer) as n_rows, cast(count(distinct c_mktsegment) as integer) as n_segments from customer group by c_custkey // 40",
    "json_text": f"select n_nationkey as article, {_JSON.format(_ODD.format('\u00e9 \U0001f600'))} as json, {_JSON.format(_ODD.format('\\u00e9 \\ud83d\\ude00'))} as ascii from nation",
    "text_dump": f"with {_CUSTOMERS} select article, md5(concat(concat_ws(chr(9), 'Key', 'Name', 'Segment'), chr(10), string_agg(concat_ws(chr(9), c_custkey, c_name, c_mktsegment), chr(10) order by r))) as digest from b group by article",
    "tsv_load": """select coalesce(source, '') as entity, coalesce(lang, '') as section, cast(d.doc_id as integer) as table_id, cast(quality as varchar) as label, coalesce(toxic, 0) + 0.25e0 as label_confidence,
        md5(regexp_replace(regexp_replace(translate(coalesce(text, ''), concat(chr(9), chr(10), chr(13)), '   '), '^\\s+', ''), '\\s+$', '')) as digest, '{}' as table_json, '|' as table_markup
        from documents d join labels l on d.doc_id = l.doc_id""",
    "pair_labels": """select cast(l.doc_id as integer) as source_table_id, cast(l.doc_id + 1 as integer) as matching_table_id, case when quality = 1 then 'equivalent' else 'noalignment' end as label, a.lang as source_lang, b.lang as matching_lang
        from labels l left join documents a on a.doc_id = l.doc_id left join documents b on b.doc_id = l.doc_id + 1""",
    # features
    "line_bucket": f"with {_LINES}, {_BUCKETS} select doc_id, bucket, count(*) as n_lines from buckets group by all",
    "token_coverage": f"{_COVERAGE} select doc_id, bucket, md5(token) as token, covered, uncovered from coverage",
    "coverage_features": f"{_COVERAGE} {_FEATURES}",
    "feature_maps": f"{_COVERAGE}, f as ({_FEATURES}) select doc_id, count(*) as n_features, sum(value) as total from f group by all",
    "line_bucket_decoded": f"with {_LINES}, {_BUCKETS} select doc_id, bucket, count(*) as n_lines from buckets group by all",
    "token_coverage_decoded": f"{_COVERAGE} select doc_id, bucket, md5(token) as token, covered, uncovered from coverage",
    "clean_markup_decoded": f"select doc_id, md5({_clean('text')}) as digest from documents",
    "bang_counts": "select doc_id, (length(text) - length(replace(text, '!!', ''))) // 2 as n_double, length(text) - length(replace(text, '!', '')) as n_single from documents",
    "rare_words": "select doc_id, w as word, count(*) as n from (select doc_id, unnest(string_split(lower(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')), ' ')) as w from documents) group by all having count(*) < 3",
    "char_class_profile": f"""with v as (select p_brand, i, case i when 0 then p_name when 1 then p_type when 2 then cast(p_size as varchar) else cast(p_partkey as varchar) end as value from part cross join (values (0), (1), (2), (3)) as x(i)),
        k as (select p_brand, i, {_LETTERS} as kind from (select *, regexp_replace(value, '[ "&]', '', 'g') as c from v)),
        s as (select p_brand, case when i < 1 then 0 else cast(floor((i - 1) * 9.0 / 3) as integer) + 1 end as bucket, n, count(*) filter (where kind = n) / cast(count(*) as double) as share from k cross join (values ('num'), ('lt'), ('ot')) as y(n) group by p_brand, i, n)
        select p_brand, concat('col-', n, '-', bucket) as feature, round(avg(share), 9) as value from s group by all""",
    "jaccard": "select page_id, round(" + _JACCARD.format(f"string_split({_TAGLESS}, ' ')", f"string_split({_TITLE}, ' ')") + ", 9) as jacc from pages",
    "kl_divergence": f"with {_divergence('page_id', 'pages', _TAGLESS, _TITLE)} select page_id, round(kl, 6) as kl from kl",
    "clean_markup": f"select doc_id, md5({_clean('text')}) as digest from documents",
    "feature_union": f"""{_COVERAGE},
        cs as (select c_custkey // 40 as article, bucket, case bucket when 0 then cast(c_custkey as varchar) when 1 then c_name else if(c_custkey % 3 = 0, cast(c_nationkey as varchar), c_mktsegment) end as c from customer cross join (values (0), (1), (5)) as x(bucket)),
        ks as (select article, bucket, {_LETTERS} as kind from (select article, bucket, regexp_replace(c, '[ "&]', '', 'g') as c from cs)),
        shares as (select article, bucket, n as kind, count(*) filter (where kind = n) / cast(count(*) as double) as share from ks cross join (values ('num'), ('lt'), ('ot')) as y(n) group by all),
        t as (select doc_id, {_STRIPPED_TEXT} as h, {_clean('text')} as m, text from documents), {_divergence('doc_id', 't', 'h', 'm')},
        f as ({_FEATURES} union all select doc_id, 'kl', kl from kl
        union all select doc_id, 'jacc', {_JACCARD.format("string_split(h, ' ')", "string_split(m, ' ')")} from t
        union all select doc_id, 'num_cols', 4 + cast(doc_id % 3 = 0 as integer) from t
        union all select doc_id, 'markup_double_exlamanation', (length(text) - length(replace(text, '!!', ''))) // 2 from t
        union all select doc_id, 'markup_single_exlamanation', length(text) - length(replace(text, '!', '')) from t
        union all select doc_id, concat('col-', kind, '-', bucket), share from documents join shares on doc_id // 40 = article)
        select doc_id, feature, round(cast(value as double), 6) as value from f""",
}

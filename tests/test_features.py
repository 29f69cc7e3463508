from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftable.functions import features as X
from weftable.functions import nested_json as J
from weftable.functions import text as T
from weftable.operators import relational as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("lines", "at", "bucket"), [(1, 0, -1), (11, 0, -1), (11, 1, 0), (11, 10, 8)])
def test_line_bucket(spark, lines, at, bucket):
    assert one(spark, X.line_bucket(F.lit(at), F.lit(lines))) == bucket


def test_jaccard(spark):
    assert one(spark, X.jaccard(F.lit("a b a c"), F.lit("a c d"))) == 0.5
    assert one(spark, X.jaccard(F.lit(""), F.lit(""))) == 1.0


def kl(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, a string, b string")
    return {r["k"]: r["kl"] for r in X.kl_divergence(df, F.col("a"), F.col("b"), "k").collect()}


def plain_kl(a, b):
    x, y = Counter(a.lower().split(" ")), Counter(b.lower().split(" "))
    n, m = sum(x.values()), sum(y.values())
    return sum((x[w] or 0.001) / n * math.log(((x[w] or 0.001) / n) / ((y[w] or 0.001) / m)) for w in {*x, *y})


def test_kl(spark):
    pairs = [("a b a c", "a c d"), ("x y", "x y"), ("", "a"), ("A a", "a a")]
    found = kl(spark, pairs)
    assert found[0] == pytest.approx(1.7840314782) and found[1] == 0
    assert all(found[i] == pytest.approx(plain_kl(*p)) for i, p in enumerate(pairs))


def test_clean_markup(spark):
    assert one(spark, T.clean_markup(F.lit('{{x}} + y "z"'))) == "x    y  z"
    assert one(spark, T.clean_markup(F.lit('colspan=2 | a <ref name=q>b</ref>c <span >d</span>'))) == "2   a  c d"
    assert one(spark, T.clean_markup(F.lit(None).cast("string"))) is None


def test_escapes(spark):
    assert one(spark, T.string_escape(F.lit("a\\nb\\x41"))) == "a\nbA"
    assert one(spark, T.unicode_escape(F.lit("é \\u00e9\\n\\q"))) == "é é\n\\q"


def test_payload_and_urls(spark):
    assert one(spark, T.payload(F.lit("e\t<p>"))) == "\t<p>" and one(spark, T.payload(F.lit("<p>"))) == "<p>"
    assert one(spark, T.article_url(F.lit("Brand #1 é"), "u/")) == "u/Brand_%231_%C3%A9"
    assert one(spark, T.strip_comments(F.lit("a<!-- b -->c<!-- d\n -->e"))) == "ac<!-- d\n -->e"
    assert [one(spark, T.integer(F.lit(x))) for x in ("+5", "2;", "", " 1", "-3", "99999999999")] == [5, None, None, None, -3, None]


def test_token_coverage(spark):
    df = spark.createDataFrame([(1, "{| class=x\n|+ caption\n! A !! B\n| A || 1-2\n| style=1 || cap", "the cap", ["A ", "B"])], "k int, table_markup string, table_caption string, columns array<string>")
    got = {(r["bucket"], r["token"]): (r["covered"], r["uncovered"]) for r in X.token_coverage(df, "k").collect()}
    assert got == {(2, "A "): (1, 0), (2, " B"): (0, 1), (4, "A "): (1, 0), (4, " 1"): (0, 1), (4, "2"): (0, 1)}


def test_char_classes(spark):
    assert [one(spark, X.char_class(F.lit(v))) for v in ("a é", "1 2", "", "a1", '"7"', "٣")] == ["lt", "num", "ot", "ot", "num", "num"]


def test_rare_words(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "A é"), (1, "a b")], "k int, value string")
    assert {(r["word"], r["n"]) for r in X.rare_words(df, "k").collect()} == {("b", 2), ("", 1)}


def test_table_features_of_null_and_empty(spark):
    schema = "table_id int, table_caption string, table_html string, table_markup string, columns array<string>, header array<struct<level:int,columns:array<struct<name:string,value_dist:array<struct<value:string,count:int>>>>>>"
    df = spark.createDataFrame([(1, None, None, None, None, None), (2, "", "", "", [], [])], schema)
    found = {(r["table_id"], r["feature"]): r["value"] for r in X.table_features(df).collect()}
    assert found[2, "jacc"] == 1.0 and found[2, "kl"] == 0.0 and found[2, "num_cols"] == 0.0
    assert X.table_features(df.limit(0)).count() == 0
    assert {r["table_id"] for r in X.feature_map(X.table_features(df)).collect()} == {1, 2}


def test_json_escapes(spark):
    assert one(spark, J.ascii_json(F.lit('{"a":"é😀x"}'))) == '{"a":"\\u00e9\\ud83d\\ude00x"}'


def test_load_table_of_broken_json(spark):
    df = spark.createDataFrame([("{",), ("",), (None,), ('{"caption":"c","id":3}',)], "j string")
    got = df.select(J.load_table("j").alias("t")).select("t.caption", "t.id").collect()
    assert [tuple(r) for r in got] == [(None, None)] * 3 + [("c", 3)]


@given(st.lists(st.sampled_from("hd"), max_size=10))
@settings(max_examples=15, deadline=None)
def test_both_forms_of_segmentation(spark, kinds):
    if not kinds:
        return
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "t int, i int, k string")
    a = [r["sub_id"] for r in R.segments(rows, F.col("k") == "h", F.col("k") == "d", ["t"], ["i"]).orderBy("i").collect()]
    flags = F.array(*[F.lit(k == "d") for k in kinds])
    assert a == one(spark, R.segments_of(flags))


def test_segments_of_a_key_of_any_size(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, None, 2]), i, rng.choice("hdx")) for i in range(800)]
    df = spark.createDataFrame(rows, "t int, i int, k string")
    args = (F.col("k") == "h", F.col("k") == "d", ["t"], ["i"])
    plain, spread = R.segments(df, *args), R.segments(df.repartition(3), *args, spread=True)
    assert plain.columns == spread.columns
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, spread.collect()), key=str)
    assert R.segments(df.limit(0), *args, spread=True).count() == 0


STEPS = (('\\\\"', '"'), ('style="?(.*?)"', " "), ('(\\\\n)|(class="?wikitable"?)|(colspan=(.*?))|(rowspan=(.*?))|\\|+', " "), ("<ref(\\s?name=(.*?))?>(.*?)</ref>", " "), ("</?span\\s*>", ""), ('(bgcolor="(.*?)")|(align="(.*?)")', " "), ("\\]+|\\[+|\"+|'+|!+|\\}+|\\{+|\\n+|\\++", " "), ("^\\s+", ""), ("\\s+$", ""))


def test_clean_markup_is_its_plain_substitutions(spark):
    """Random markup through the substitutions as the established ones are written."""
    parts = ["a", " ", "\n", "\t", "\\n", '\\"', '"', "style=", 'style="x"', "class=wikitable", 'class="wikitable"', "colspan=", "rowspan=2", "|", "||", "<ref>", "<ref name=q>", "</ref>", "</span >", "<span>", 'bgcolor="r"', 'align="', "[[", "]", "!", "!!", "}", "{", "{{", "''", "++", "é", "[{"]
    r = random.Random(7)
    texts = ["".join(r.choices(parts, k=r.randrange(40))) for _ in range(400)]
    plain = F.col("x")
    for pattern, by in STEPS:
        plain = F.regexp_replace(plain, pattern, by)
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert all(row["a"] == row["b"] for row in df.select(T.clean_markup("x").alias("a"), plain.alias("b")).collect())


def test_profiles_are_made_of_headers_alone(spark):
    """No text meets a header, and the features are those of tables that have the header themselves."""
    dist = "array<struct<value:string,count:int>>"
    headers = spark.createDataFrame([(1, [([("A", [("x", 2), ("1", 1)]), ("B", [("?", 1)])],)]), (2, [([("A", [])],)])], f"article int, header array<struct<columns:array<struct<name:string,value_dist:{dist}>>>>")
    docs = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 3), (14, None)], "doc_id int, article int").selectExpr("*", "'c' as table_caption", "'<p>a b' as table_html", "'| a !! b' as table_markup", "array('a') as columns")
    want = X.table_features(docs.join(headers, "article", "left"), "doc_id")
    found = X.table_features(docs, "doc_id").unionByName(X.profile_features(docs, headers, "article", "doc_id"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_escapes_as_python_decodes_them(spark):
    parts = ["a", "é", "\n", "\\", "\\\\", "\\'", '\\"', "\\a\\b\\f\\n\\r\\t\\v", "\\\n", "\\0", "\\7", "\\101", "\\18", "\\x41", "\\x4", "\\xzz", "\\x7f", "\\q", "\\8", "\u2028"]
    rare = ["\\xc3\\xa9", "\\xe9", "\\303\\251", "\\377", "\\400", "\\u00e9", "\\ud83d\\ude00", "\\ud83d", "\\U0001f600", "\\u12"]
    r = random.Random(3)
    texts = [None, "", *["".join(r.choices(parts if i % 2 else parts + rare, k=r.randrange(12))) for i in range(600)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    for mine, plain in ((T.string_escape, T._string_escape), (T.unicode_escape, T._unicode_escape)):
        found = {row["i"]: row["y"] for row in df.select("i", mine("x").alias("y")).collect()}
        assert found == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("decode", "rare"), [("string_escape", "\\xe9"), ("unicode_escape", "\\u0100")])
def test_only_rare_escapes_reach_python(spark, decode, rare):
    """The Python worker of a text without them gets a null."""
    df = spark.createDataFrame([("a\\nb",), ("c",), (rare,)], "x string")
    plan = df.select(getattr(T, decode)("x").alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "CASE WHEN RLIKE(x" in plan.split("ArrowEvalPython")[1]

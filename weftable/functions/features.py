"""Features of labelled tables: long rows (key, feature, value) are the canonical form, maps come on demand.

Input columns of a table: table_caption, table_html, table_markup, columns (array of names in order) and header
(levels with value_dist, as from load_table).
"""

from __future__ import annotations

from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftable.functions import text as T

BINS = 10


def line_bucket(index: Column, lines: Column, bins: int = BINS) -> Column:
    """Equi-width bucket of a line's 0-based index: -1 for the first line, bins - 2 for the last possible."""
    return (F.coalesce(F.width_bucket(index.cast("double"), F.lit(1.0), lines.cast("double"), F.lit(bins - 1)), F.lit(0)) - 1).cast("int")


def markup_lines(df: DataFrame, markup: str, *keep: str, bins: int = BINS, decode: bool = False) -> DataFrame:
    """(keep, pos, line, bucket): stripped lines of the markup."""
    c = T.string_escape(F.col(markup)) if decode else F.col(markup)
    lines = df.select(*keep, F.split(c, "\n").alias("_lines")).select(*keep, F.size("_lines").alias("_n"), F.posexplode("_lines").alias("pos", "line"))
    return lines.withColumn("line", T.strip("line")).withColumn("bucket", line_bucket(F.col("pos"), F.col("_n"), bins)).drop("_n")


def tokens(line: Column) -> Column:
    """Cell delimiters to tabs, stripped, split; tokens themselves are not trimmed."""
    return F.split(T.strip(F.regexp_replace(line, "(?=[-!|])(?:!+|\\|+|-)", "\t")), "\t")


def skipped_line(line: Column) -> Column:
    return line.rlike("^\\{\\|\\s?class=") | line.startswith("|+") | (line == "")


def skipped_token(token: Column, caption: Column) -> Column:
    start = F.lit(False)
    for word in ("colspan", "rowspan", "bgcolor", "style", "class"):
        start = start | token.startswith(word)
    return (token == "") | F.coalesce(F.contains(caption, token), F.lit(False)) | start


def let(value: Column, body) -> Column:
    """body of a lambda variable that holds the value: made once, where a column that a lambda names might be put
    into the lambda by the optimizer and made again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_counts(items: Column) -> Column:
    """Array of (item, n): how often each distinct element of an array occurs, by sorting within the row."""

    def of(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(s, i - 1)), i)))
        return let(starts, lambda p: F.transform(p, lambda at, i: F.struct(F.get(s, at).alias("item"), (F.coalesce(F.get(p, i + 1), F.size(s)) - at).cast("bigint").alias("n"))))

    return let(F.sort_array(items), of)


def coverage(markup: Column, caption: Column, columns: Column, values: Column | None = None, bins: int = BINS) -> Column:
    """Array of (bucket, token, known, n) of one table's markup, made within the row."""
    lines = F.transform(F.split(markup, "\n"), lambda x: T.strip(x))
    none = F.array().cast("array<string>")

    def of(title: Column, names: Column, all_: Column) -> Column:
        split = lambda x, i: F.transform(F.when(skipped_line(x), none).otherwise(tokens(x)), lambda t: F.struct(line_bucket(i, F.size(all_), bins).alias("bucket"), t.alias("token")))
        each = F.filter(F.flatten(F.transform(all_, split)), lambda e: ~skipped_token(e["token"], title))
        known = lambda t: F.coalesce(F.array_contains(names, t), F.lit(False))
        return F.transform(run_counts(each), lambda r: F.struct(r["item"]["bucket"].alias("bucket"), r["item"]["token"].alias("token"), known(r["item"]["token"]).alias("known"), r["n"].alias("n")))

    names = columns if values is None else F.concat(columns, values)
    return let(caption, lambda title: let(names, lambda k: let(lines, lambda all_: of(title, k, all_))))


def token_coverage(df: DataFrame, *key: str, markup: str = "table_markup", caption: str = "table_caption", columns: str = "columns", values: str | None = None, bins: int = BINS, decode: bool = False) -> DataFrame:
    """(key, bucket, token, covered, uncovered). A token is covered if it is a column name; with `values` (an array
    column), if it is a column name or one of those values. A key is a row."""
    if decode:  # in a column of its own: higher-order functions take no Python
        df = df.withColumn(markup, T.string_escape(F.col(markup)))
    found = coverage(F.col(markup), F.col(caption), F.col(columns), F.col(values) if values else None, bins)
    n, known = F.col("c.n"), F.col("c.known")
    # explode_outer: for explode() the optimizer tests the array's size beforehand, which would make it twice
    return df.select(*key, F.explode_outer(found).alias("c")).filter("c is not null").select(*key, "c.bucket", "c.token", F.when(known, n).otherwise(0).alias("covered"), F.when(known, 0).otherwise(n).alias("uncovered"))


def feature_name(bucket: Column, covered: Column, uncovered: Column, bins: int = BINS) -> Column:
    """"<line bucket>-<coverage bin>"."""
    ratio = covered / (covered + uncovered).cast("double")
    bin_ = (F.width_bucket(ratio, F.lit(0.0), F.lit(1.0), F.lit(bins - 1)) - 1).cast("int")
    return F.concat_ws("-", bucket.cast("string"), bin_.cast("string"))


def coverage_features(coverage: DataFrame, *key: str, bins: int = BINS) -> DataFrame:
    """(key, feature, value): "<line bucket>-<coverage bin>" -> number of distinct tokens."""
    name = feature_name(F.col("bucket"), F.col("covered"), F.col("uncovered"), bins)
    return coverage.groupBy(*key, name.alias("feature")).agg(F.count("*").cast("double").alias("value"))


def leaf_columns(header: Column) -> Column:
    return F.try_element_at(header, F.lit(-1))["columns"]


def rare_words(histogram: DataFrame, *key: str, value: str = "value", below: int = 3, decode: bool = False) -> DataFrame:
    """(key, word, n) of the ASCII, lower-cased, space-separated words of distinct values with n below the bound."""
    c = F.regexp_replace(F.col(value), "[^\\x00-\\x7F]", "")
    if decode:
        c = T.unicode_escape(c)
    return histogram.select(*key, F.explode(F.split(F.lower(c), " ")).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("n")).filter(F.col("n") < below)


def char_class(value: Column) -> Column:
    """lt, num or ot of a value without spaces, quotes and ampersands."""
    v = F.regexp_replace(value, '[ "&]', "")
    return F.when(v.rlike("^\\p{L}+$"), "lt").when(v.rlike("^[\\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"), "num").otherwise("ot")


def char_class_profile(histogram: DataFrame, *key: str, columns: Column | None = None, bins: int = BINS) -> DataFrame:
    """(key, feature, value): col-num-i, col-lt-i and col-ot-i, the classes' shares averaged over bucket i's columns.

    histogram: key, col_index (0-based), value, count; `columns` is the table's number of columns (default: a column
    num_columns). Columns without values have rows with a null value, and count as shares of 0.
    """
    kind = char_class(F.col("value"))
    n = F.coalesce(F.col("count"), F.lit(0))
    total = columns if columns is not None else F.col("num_columns")
    shares = histogram.groupBy(*key, "col_index", total.alias("num_columns")).agg(*[F.sum(F.when(F.col("value").isNotNull() & (kind == k), n).otherwise(0)).cast("double").alias(k) for k in ("num", "lt", "ot")])
    all_ = F.col("num") + F.col("lt") + F.col("ot")
    bucket = F.coalesce(F.width_bucket(F.col("col_index").cast("double"), F.lit(1.0), F.col("num_columns").cast("double"), F.lit(bins - 1)), F.lit(0))
    shares = shares.withColumn("_all", F.when(all_ == 0, 1.0).otherwise(all_)).withColumn("bucket", bucket)
    means = shares.groupBy(*key, "bucket").agg(*[F.avg(F.col(k) / F.col("_all")).alias(k) for k in ("num", "lt", "ot")])
    return means.select(*key, F.explode(F.create_map(*[x for k in ("num", "lt", "ot") for x in (F.concat(F.lit(f"col-{k}-"), F.col("bucket").cast("string")), F.col(k))])).alias("feature", "value"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of the sets of single-space-separated tokens; the empty token counts."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double")


@F.arrow_udf(DoubleType())
def _divergence(a: pa.Array, b: pa.Array, epsilon: pa.Array) -> pa.Array:
    return pa.array((None if x is None or y is None else _kl(x, y, e) for x, y, e in zip(a.to_pylist(), b.to_pylist(), epsilon.to_pylist())), pa.float64())


def _kl(a: str, b: str, epsilon: float) -> float:
    x, y = Counter(a.split(" ")), Counter(b.split(" "))
    n, m = x.total(), y.total()
    side = sum(c / n * log(c / n / ((y.get(w) or epsilon) / m)) for w, c in x.items())
    return side + sum(epsilon / n * log(epsilon / n / (c / m)) for w, c in y.items() if w not in x)


def divergence(a: Column, b: Column, epsilon: float = 0.001) -> Column:
    """Divergence of the lower-cased unigram distributions of a from b; words that one side lacks have epsilon in place
    of their count. Null where a or b is. Counted in Arrow batches: sorting words within rows by higher-order
    functions took ten times as long, exploding them a shuffle of every word."""
    return _divergence(F.lower(a), F.lower(b), F.lit(epsilon))


def kl_divergence(df: DataFrame, a: Column, b: Column, *key: str, epsilon: float = 0.001) -> DataFrame:
    """(key, kl) of the rows whose a and b aren't null; see divergence()."""
    return df.filter(a.isNotNull() & b.isNotNull()).select(*key, divergence(a, b, epsilon).alias("kl"))


def class_profile(leaf: Column, bins: int = BINS) -> Column:
    """Array of (feature, value) of char_class_profile() for the leaf columns of a row's own header."""
    kinds = ("num", "lt", "ot")
    count = lambda c, k: F.aggregate(F.filter(c["value_dist"], lambda v: char_class(v["value"]) == k), F.lit(0.0), lambda s, v: s + F.coalesce(v["count"], F.lit(0)))
    sums = F.transform(leaf, lambda c: F.struct(*[F.coalesce(count(c, k), F.lit(0.0)).alias(k) for k in kinds]))
    all_ = lambda s: s["num"] + s["lt"] + s["ot"]

    def shares(t: Column) -> Column:
        bucket = lambda i: F.coalesce(F.width_bucket(i.cast("double"), F.lit(1.0), F.size(t).cast("double"), F.lit(bins - 1)), F.lit(0))
        return F.transform(t, lambda s, i: F.struct(bucket(i).alias("bucket"), *[F.when(all_(s) == 0, 0.0).otherwise(s[k] / all_(s)).alias(k) for k in kinds]))

    def features(t: Column) -> Column:
        def of(b: Column) -> Column:
            mean = lambda here, k: F.aggregate(here, F.lit(0.0), lambda v, s: v + s[k]) / F.size(here)
            return let(F.filter(t, lambda s: s["bucket"] == b), lambda here: F.array(*[F.struct(F.concat(F.lit(f"col-{k}-"), b.cast("string")).alias("feature"), mean(here, k).alias("value")) for k in kinds]))

        return F.flatten(F.transform(F.array_distinct(F.transform(t, lambda s: s["bucket"])), of))

    return let(let(sums, shares), features)


def table_features(df: DataFrame, key: str = "table_id", bins: int = BINS, decode: bool = False) -> DataFrame:
    """All features of tables, long form. df: a row per table with key, table_caption, table_html, table_markup,
    columns, header. Every feature is made within its row: one pass, no shuffle. Without a column header, those of the
    columns' values are left out; profile_features() makes them of headers that lie elsewhere."""
    df = df.withColumn("_plain", T.string_escape(F.col("table_markup")) if decode else F.col("table_markup"))
    covered = coverage(F.col("_plain"), F.col("table_caption"), F.col("columns"), bins=bins)
    own = ["header"] if "header" in df.columns else []
    df = df.select(key, "table_markup", "columns", *own, covered.alias("_coverage"), T.strip_tags("table_html").alias("_html"), T.clean_markup("table_markup", decode).alias("_markup"))
    one, none = F.lit(1), F.lit(0)
    names = F.transform("_coverage", lambda c: feature_name(c["bucket"], F.when(c["known"], one).otherwise(none), F.when(c["known"], none).otherwise(one), bins))
    pair = lambda name, value: F.struct(F.lit(name).alias("feature"), value.alias("value"))
    scalars = F.array(
        pair("jacc", jaccard(F.col("_html"), F.col("_markup"))),
        pair("num_cols", F.size("columns").cast("double")),
        pair("markup_double_exlamanation", T.count_of("table_markup", "!!").cast("double")),
        pair("markup_single_exlamanation", T.count_of("table_markup", "!").cast("double")),
        pair("kl", divergence(F.col("_html"), F.col("_markup"))),
    )
    some = lambda c: F.coalesce(c, F.array().cast("array<struct<feature:string,value:double>>"))
    buckets = F.transform(run_counts(names), lambda r: F.struct(r["item"].alias("feature"), r["n"].cast("double").alias("value")))
    profile = [some(class_profile(leaf_columns(F.col("header")), bins))] if own else []
    found = df.select(key, F.explode_outer(F.concat(some(buckets), scalars, *profile)).alias("f")).select(key, "f.feature", "f.value")
    return found.filter("feature <> 'kl' or value is not null")


def profile_features(keys: DataFrame, headers: DataFrame, on: str, key: str = "table_id", bins: int = BINS) -> DataFrame:
    """The features that table_features() makes of a header, for tables whose header is another table's: keys has key
    and on, headers on and header. A profile is made once for each header, and no text is shuffled to it."""
    profiles = headers.select(on, class_profile(leaf_columns(F.col("header")), bins).alias("_profile"))
    found = keys.select(key, on).join(profiles, on).select(key, F.explode("_profile").alias("f"))
    return found.select(key, "f.feature", "f.value")


def feature_map(long: DataFrame, key: str = "table_id") -> DataFrame:
    """One map of features per table (its number of features is bounded by its bins and scalars)."""
    return long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("features"))

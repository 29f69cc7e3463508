"""Text primitives on HTML and wiki markup, as Catalyst expressions; only rare escapes are decoded by Arrow UDFs."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ARTICLE_URL = "https://en.wikipedia.org/api/rest_v1/page/html/"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """All white space off both ends, not only spaces."""
    return F.btrim(_col(c), F.lit(" \t\n\x0b\f\r"))


def strip_comments(html: Column | str) -> Column:
    """HTML comments of one line; those that span lines stay."""
    return F.regexp_replace(_col(html), "<!--(.*?)-->", "")


def escape_newlines(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\n"), F.lit("\\n"))


def unescape_newlines(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\\n"), F.lit("\n"))


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(_col(html), "<[^>]+>", " ")


def payload(line: Column | str) -> Column:
    """From the first tab on (the tab kept), or the whole line."""
    c = _col(line)
    return F.when(F.instr(c, "\t") > 0, F.substr(c, F.instr(c, "\t"))).otherwise(c)


def article_url(entity: Column | str, base: str = ARTICLE_URL) -> Column:
    return F.concat(F.lit(base), F.url_encode(F.replace(_col(entity), F.lit(" "), F.lit("_"))))


def count_of(c: Column | str, part: str) -> Column:
    """Non-overlapping occurrences."""
    c = _col(c)
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("bigint")


def integer(c: Column | str) -> Column:
    """An integer with an optional sign and nothing around it, else null."""
    c = _col(c)
    return F.when(c.rlike("^[+-]?[0-9]+$"), c.try_cast("int"))


_ESCAPE = re.compile(rb"\\(?:\\|'|\"|a|b|f|n|r|t|v|\n|[0-7]{1,3}|x[0-9a-fA-F]{2})")


def _string_escape(s: str) -> str:
    return _ESCAPE.sub(lambda m: codecs.escape_decode(m.group())[0], s.encode()).decode("utf-8", "replace")


def _unicode_escape(s: str) -> str:
    """Escapes decoded, other characters kept as they are; broken escapes stay."""
    out = re.sub(r"\\(?:\\|'|\"|[abfnrtv\n]|[0-7]{1,3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})", _decoded, s)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _decoded(m: re.Match) -> str:
    try:
        return m.group().encode().decode("unicode_escape")
    except UnicodeDecodeError:
        return m.group()


#: Texts that Python decodes at once.
_SLICE = 64


def _mapped(fn: Callable[[str], str], texts: pa.Array) -> pa.Array:
    made = [pa.array([None if s is None else fn(s) for s in texts.slice(i, _SLICE).to_pylist()], pa.string()) for i in range(0, len(texts), _SLICE)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _all_byte_escapes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _mapped(_string_escape, texts)


@F.arrow_udf(StringType())
def _all_character_escapes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _mapped(_unicode_escape, texts)


#: An escape of one character below 256, a run without backslashes, or a backslash that begins no escape.
_PIECE = "\\\\(?:[\\\\'\"abfnrtv\n]|[0-7]{1,3}|x[0-9a-fA-F]{2})|[^\\\\]+|\\\\"


def _short_escapes(c: Column) -> Column:
    """Escapes of characters below 256 decoded within the JVM."""

    def decoded(p: Column) -> Column:
        kind = F.substr(p, F.lit(2), F.lit(1))
        number = lambda at, base: F.char(F.conv(F.substr(p, F.lit(at)), base, 10).cast("bigint"))
        plain = ~p.startswith("\\") | (F.length(p) == 1)
        one = F.translate(kind, "abfnrtv\n", "\x07\b\f\n\r\t\x0b")  # an escaped line feed is nothing
        return F.when(plain, p).when(kind == "x", number(3, 16)).when(kind.between("0", "7"), number(2, 8)).otherwise(one)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), decoded), "")


def _unescaped(c: Column, rare: str, udf: Callable[[Column], Column]) -> Column:
    """Texts with an escape that looks like `rare` go to Python whole, all others stay in the JVM."""
    there = c.rlike(rare)
    return F.when(there, udf(F.when(there, c))).when(F.contains(c, F.lit("\\")), _short_escapes(c)).otherwise(c)


def string_escape(c: Column | str) -> Column:
    """Byte escapes (\\n, \\x41, octal) to their bytes; bytes beyond ASCII make characters in Python."""
    return _unescaped(_col(c), "\\\\(?:x[89a-fA-F][0-9a-fA-F]|[2-7][0-7]{2})", _all_byte_escapes)


def unicode_escape(c: Column | str) -> Column:
    """Character escapes (\\n, \\u0041) to their characters; those beyond 255 in Python."""
    return _unescaped(_col(c), "\\\\(?:[uU]|[4-7][0-7]{2})", _all_character_escapes)


#: Substitutions of clean_markup() in order. Each begins with one set of characters, which most of a text isn't in; a
#: lazy group at the end of an alternative takes nothing and is left out.
MARKUP_STEPS = (
    ('\\\\"', '"'),
    ('style="?(.*?)"', " "),
    ('(?=[\\\\cr|])(?:\\\\n|class="?wikitable"?|colspan=|rowspan=|\\|+)', " "),
    ("<ref(?:\\s?name=(?:.*?))?>(?:.*?)</ref>", " "),
    ("</?span\\s*>", ""),
    ('(?=[ab])(?:bgcolor|align)="(?:.*?)"', " "),
    ("([\\]\\[\"'!}{\\n+])\\1*", " "),
)


def clean_markup(markup: Column | str, decode: bool = False) -> Column:
    """Plain words of wiki markup. decode: escapes are decoded first, in Python."""
    c = _col(markup)
    if decode:
        c = unicode_escape(c)
    for pattern, by in MARKUP_STEPS:
        c = F.regexp_replace(c, pattern, by)
    return strip(c)

"""Personal data in whole texts, with offset-preserving deobfuscation.

Base detectors run on the text itself. Then transducers rewrite disguises: homoglyphs and compatibility forms
to ASCII, invisible characters to nothing, spelled digits to digits, and disguised "at" and "dot" to "@" and ".".
Each carries, for every character that it writes, the span of the source that it stands for, and transducers
compose. The same detectors run on the result, and what they find is mapped back to the source. Only findings
in which a character was rewritten or left out, and which lie in no base finding of their kind, are added. Base findings
stay, so where a disguise hides one end of a finding, its plain part and the whole stand beside each other.

Offsets are code points, ends exclusive. Defined results: null text is empty (no findings); repeated rows give
repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from weftable.llm.common import key_and_text, map_blocks
from weftable.llm.top_level import TOP

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting in a run of digits only at its start changes no match and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches: every match has its "@" after the longest run of local characters since the last match."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted; matches that fail their check are dropped without another try."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- transducers -------------------------------------------------------------------------------------------

_LIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "п": "n", "г": "r", "в": "b", "з": "3",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "•": ".", "٫": ".", "⁄": "/", "ⓐ": "@", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
_GONE = frozenset("­᠎​‌‍⁠⁡⁢⁣﻿")
#: Characters that a disguise may use; Latin letters with accents are none.
_ODD = re.compile("[­·ıɑɡͰ-ϿЀ-ԯ٠-٩۰-۹०-९᠎ -₟℀-↏−①-⓿。＀-￯﻿\U0001d400-\U0001d7ff\U0001fbf0-\U0001fbf9]")
#: Spoken forms by language: digits from 0 on (spellings parted by "/"), signs, and words for repetition.
SPOKEN = {
    "en": {"digits": "zero/oh one two three four five six seven eight nine", "at": "at", "dot": "dot", "plus": "plus", "double": "double", "triple": "triple"},
    "de": {"digits": "null eins zwei/zwo drei vier fünf/fuenf sechs sieben acht neun", "at": "at ät klammeraffe", "dot": "punkt", "plus": "plus", "double": "doppel", "triple": "dreifach"},
    "fr": {"digits": "zéro/zero un/une deux trois quatre cinq six sept huit neuf", "at": "arobase arrobas", "dot": "point", "plus": "plus", "double": "double", "triple": "triple"},
    "es": {"digits": "cero uno/una dos tres cuatro cinco seis siete ocho nueve", "at": "arroba", "dot": "punto", "plus": "más mas", "double": "doble", "triple": "triple"},
}


def _either(words) -> str:
    return "(?:" + "|".join(sorted(set(words), key=lambda w: (-len(w), w))) + ")"


def _said(name: str) -> list[str]:
    return [w for spoken in SPOKEN.values() for w in spoken[name].split()]


_NUMBERS = {w: str(i) for spoken in SPOKEN.values() for i, ws in enumerate(spoken["digits"].split()) for w in ws.split("/")}
_TIMES_OF = dict.fromkeys(_said("double"), 2) | dict.fromkeys(_said("triple"), 3)
_PLUS_WORDS = frozenset(_said("plus"))
_NUMBER, _AT, _DOT, _PLUS, _MANY = _either(_NUMBERS), _either(_said("at")), _either(_said("dot")), _either(_PLUS_WORDS), _either(_TIMES_OF)
_SIGN = dict.fromkeys(_said("at"), "@") | dict.fromkeys(_said("dot"), ".")
_SEP = r"[ ,.-]{1,3}"
_TIMES = rf"(?:{_MANY}[ -]+)?"
_DIGITS = rf"{_TIMES}(?:{_NUMBER}|[0-9]++)"
#: A run of spelled digits and digits, with "plus" before, "double" and "triple" among them, and a spoken "dot" beside it.
_SPELLED = re.compile(rf"(?P<before>\b{_DOT}[ \t]+)?\b(?P<run>(?:{_PLUS}{_SEP})?{_DIGITS}(?:{_SEP}{_DIGITS})*)\b(?=(?P<after>[ \t]+{_DOT}\b)?)", re.I)
_ANY_NUMBER = re.compile(_NUMBER, re.I)
_SPELLED_TOKEN = re.compile(rf"{_PLUS}|{_MANY}|{_NUMBER}|[0-9]+", re.I)
_BOXED = re.compile(rf"(?<![ \t])[ \t]*[\[({{<][ \t]*({_AT}|{_DOT}|@|\.)[ \t]*[\])}}>][ \t]*", re.I)
_LABEL = r"[A-Za-z0-9-]+"
_TOP = re.compile(TOP, re.I)
_ONE_CASE = re.compile("[a-z0-9-]+|[A-Z0-9-]+")
#: "name at host dot com": signs and words are read from the "at" on to both sides, so any number of them costs linear
#: time. The name is read backwards, in the reversed text.
_SPOKEN_SIGN = re.compile(rf"[ \t]+{_AT}[ \t]+|[ \t]*@[ \t]*", re.I)
_NAME = re.compile(rf"[A-Za-z0-9._%+-]++(?:[ \t]+{_either(w[::-1] for w in _said('dot'))}[ \t]+[A-Za-z0-9._%+-]++)*+", re.I)
_HOST = re.compile(rf"{_LABEL}(?:(?:\.|[ \t]+{_DOT}[ \t]+){_LABEL})+", re.I)
_HOST_SEP = re.compile(rf"\.|[ \t]+{_DOT}[ \t]+", re.I)
_NAME_SEP = re.compile(rf"[ \t]+{_DOT}[ \t]+", re.I)
_SPOKEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|[ \t]+{_DOT}[ \t]+)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_SPACED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[ \t]+@[ \t]+{_LABEL}(?:[ \t]*\.[ \t]*{_LABEL})+(?![A-Za-z0-9-])")
_SPOKEN_TOKEN = re.compile(rf"[ \t]+({_AT}|{_DOT})[ \t]+|[ \t]*(@)[ \t]*|[ \t]*(\.)[ \t]*", re.I)
_WORDY = re.compile(rf"[\[({{<][ \t]*(?:{_AT}|{_DOT}|@|\.)[ \t]*[\])}}>]|[ \t]{_DOT}[ \t]|[ \t]{_AT}[ \t]+[A-Za-z0-9-]+\.[A-Za-z0-9]|[ \t]@[ \t]|\b(?:{_PLUS}|{_NUMBER}){_SEP}{_TIMES}(?:{_NUMBER}|[0-9])|[0-9]{_SEP}{_TIMES}{_NUMBER}\b", re.I)


class Mapped:
    """A rewritten text; of each character, the source span and whether it was rewritten."""

    __slots__ = ("chars", "ends", "new", "starts")

    def copy(self) -> Mapped:
        m = Mapped("")
        m.chars, m.starts, m.ends, m.new = list(self.chars), list(self.starts), list(self.ends), list(self.new)
        return m

    def __init__(self, text: str) -> None:
        self.chars: list[str] = list(text)
        self.starts: list[int] = list(range(len(text)))
        self.ends: list[int] = list(range(1, len(text) + 1))
        self.new: list[bool] = [False] * len(text)

    @property
    def text(self) -> str:
        return "".join(self.chars)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (start, end, by) in order, apart from one another; all that is put in stands for the whole span."""
        chars, starts, ends, new, last = [], [], [], [], 0
        for a, b, by in edits:
            chars += self.chars[last:a]
            starts += self.starts[last:a]
            ends += self.ends[last:a]
            new += self.new[last:a]
            for ch in by:
                chars.append(ch)
                starts.append(self.starts[a])
                ends.append(self.ends[b - 1])
                new.append(True)
            last = b
        self.chars, self.starts, self.ends, self.new = chars + self.chars[last:], starts + self.starts[last:], ends + self.ends[last:], new + self.new[last:]


def fold(ch: str) -> str:
    """ASCII look-alike of a character, "" for an invisible one, else itself."""
    if ch in _GONE:
        return ""
    got = _LIKE.get(ch)
    if got is None:
        digit = unicodedata.digit(ch, None)
        got = str(digit) if digit is not None else unicodedata.normalize("NFKC", ch)
        got = _LIKE.get(got, got)
    return got if got.isascii() and len(got) == 1 else ch


def homoglyphs(m: Mapped) -> None:
    edits = []
    for found in _ODD.finditer(m.text):
        by = fold(found.group())
        if by != found.group():
            edits.append((found.start(), found.end(), by))
    m.rewrite(edits)


def spelled_digits(m: Mapped, dots: bool = False) -> tuple[bool, bool]:
    """Joins the runs that hold a spelled digit beside a digit, another or a spoken "plus" or "dot"; with dots, a separator
    that holds a dot stays a dot. Whether there was a run, and whether there was such a separator."""
    edits, dotted, text = [], False, m.text
    for found in _SPELLED.finditer(text):
        tokens = list(_SPELLED_TOKEN.finditer(text, *found.span("run")))
        if not _ANY_NUMBER.search(text, *found.span("run")) or len(tokens) < 2 and not found["before"] and not found["after"]:
            continue
        times, head, last = 1, None, None
        for t in tokens:
            word = t.group().lower()
            if word in _TIMES_OF:
                times, head = _TIMES_OF[word], t.start()
                continue
            by = "+" if word in _PLUS_WORDS else _NUMBERS.get(word, word) * times
            start = t.start() if head is None else head
            times, head = 1, None
            if last is not None and last[2] != "+" and "." in text[last[1] : start]:
                dotted = True
                if dots:
                    edits.append((last[1], start, "."))
                    last = None
            last = (start if last is None else last[1], t.end(), by)
            edits.append(last)
    m.rewrite(edits)
    return bool(edits), dotted


def boxed(m: Mapped) -> None:
    m.rewrite([(f.start(), f.end(), _SIGN.get(f.group(1).lower(), f.group(1))) for f in _BOXED.finditer(m.text)])


def host_end(text: str, at: int, word: bool) -> int | None:
    """Where the host of a spoken address that begins at `at` ends; None where there is none. Its last label is a top-level
    domain, for "at" and "dot" are words too. With plain dots alone, "at" must be a word, and the last label in one
    case, for "at noon.It" is a sentence's end."""
    found = _HOST.match(text, at)
    if not found:
        return None
    last, spoken = None, False
    cuts = [*_HOST_SEP.finditer(text, at, found.end())]
    for cut, following in zip(cuts, [*cuts[1:], None]):
        spoken = spoken or cut.group() != "."
        end = following.start() if following else found.end()
        label = text[cut.end() : end]
        # where more of the host follows after a plain dot, this is the middle of a name
        whole = following is None or following.group() != "."
        if whole and _TOP.fullmatch(label) and (spoken or (word and _ONE_CASE.fullmatch(label))):
            last = end
    return last


def spoken_addresses(m: Mapped) -> None:
    text = m.text
    back, edits, done = None, [], 0
    for sign in _SPOKEN_SIGN.finditer(text):
        if sign.start() < done:
            continue
        end = host_end(text, sign.end(), sign.group().strip() != "@")
        if end is None:
            continue
        back = text[::-1] if back is None else back
        name = _NAME.match(back, len(text) - sign.start())
        if name is None:
            continue
        start = len(text) - name.end()
        if start < done:
            continue
        dots = [*_NAME_SEP.finditer(text, start, sign.start()), *(d for d in _HOST_SEP.finditer(text, sign.end(), end) if d.group() != ".")]
        new = [(d.start(), d.end(), ".") for d in dots] + ([(sign.start(), sign.end(), "@")] if sign.group() != "@" else [])
        edits += sorted(new)
        done = end
    m.rewrite(edits)


def at_and_dot(m: Mapped) -> None:
    spoken_addresses(m)
    for pattern in (_SPACED, _SPOKEN_IP):
        edits = []
        for f in pattern.finditer(m.text):
            for t in _SPOKEN_TOKEN.finditer(f.group()):
                word = next(g for g in t.groups() if g).lower()
                by = _SIGN.get(word, word)
                if by != t.group():
                    edits.append((f.start() + t.start(), f.start() + t.end(), by))
        m.rewrite(edits)


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Findings of the deobfuscated text in source offsets, without those that lie in a base finding of their kind."""
    odd = not text.isascii() and _ODD.search(text)
    if not odd and not _WORDY.search(text):
        return []
    m = Mapped(text)
    if odd:
        homoglyphs(m)
    boxed(m)
    # spelled digits may be words, and a dot among them may part octets or groups of a number: each reading is looked at
    readings = [m]
    for dots in (False, True):
        one = m.copy()
        any_run, dotted = spelled_digits(one, dots)
        if any_run:
            readings.append(one)
        if not dotted:
            break
    seen = set()
    for one in readings:
        at_and_dot(one)
        for a, kind, b in detect(one.text):
            # a rewritten separator at either end belongs to the neighbourhood, so ends are those of real characters
            start, end = one.starts[a], one.ends[b - 1]
            if (any(one.new[a:b]) or end - start != b - a) and not any(k == kind and s <= start and end <= e for s, k, e in base):
                seen.add((start, kind, end))
    out, reached = [], [0] * len(KINDS)
    for start, kind, end in sorted(seen, key=lambda x: (x[0], -x[2])):  # of readings that hold one another, the widest
        if end > reached[kind]:
            reached[kind] = end
            out.append((start, kind, end))
    return sorted(out)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_email, n_ip, n_card, n_phone and spans count all findings' kinds; base_sha256 digests the base ones.

    findings is the array of (kind, start, end, disguised) behind them.
    """
    kind = df.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans, items = [[], [], [], []], [], [], []
        for text in batch.column("text").to_pylist():
            base = detect(text or "")
            added = disguised(text or "", base)
            every = sorted(base + added)
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in every))
            digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
            spans.append(shown(every))
            more = set(added)
            items.append([{"kind": KINDS[k], "start": a, "end": b, "disguised": (a, k, b) in more} for a, k, b in every])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(items, pa.list_(item))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "findings"])

    schema = f"doc_id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, findings array<struct<kind:string,start:bigint,end:bigint,disguised:boolean>>"
    return map_blocks(key_and_text(df, id_col, text_col), "text", run, schema).withColumnRenamed("doc_id", id_col)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return find(df, id_col, text_col).drop("findings")

"""A lenient HTML tree for article pages, on the standard library's tokenizer.

The tree builder repairs what table markup leaves out: cells, rows and row groups close each other, paragraphs
and list items end where a block begins, void elements have no content, stray end tags are ignored. Walks are
iterative, so nesting may be of any depth.

Elements are made in document order, so an element and its descendants are a slice of the list of all elements. Pages
of plain tags and text alone are tokenized by one pattern; all others by the standard library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body frameset script noscript style meta link title frame noframes section nav aside hgroup header footer main p h1 h2 h3 h4 h5 h6 ul ol pre div blockquote hr address figure figcaption form fieldset ins del dl dt dd li table caption thead tfoot tbody colgroup col tr th td video audio canvas details menu template article center".split()
)
#: What an opening tag ends: the open elements named, up to the first of the fences.
_CLOSES = {
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    "tr": (("td", "th", "tr", "caption", "colgroup"), ("table",)),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",))),
    "caption": (("caption",), ("table",)),
    "li": (("li",), ("ul", "ol", "table", "td", "th")),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl", "table", "td", "th"))),
    "option": (("option",), ("select",)),
}
_ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_FENCED = frozenset("td th table caption section body html".split())
#: Tags whose content is no markup; the standard library knows where it ends.
_RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext textarea title".split())
#: A tag without or with quoted plain attributes, or the end of one, and the text behind it.
_TOKEN = re.compile(r'((?:<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_]*="[^"<>&]*")*)>|</([a-zA-Z][a-zA-Z0-9]*)>)([^<]*))')
_ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9_]*)="([^"]*)"')
#: Text that collapsing white space leaves as it is.
_COLLAPSED = re.compile("[^ \xa0\t\n\r\f]+(?: [^ \xa0\t\n\r\f]+)*")
#: What markup escapes in text.
_SPECIAL = re.compile("[&<>]")


class Element:
    __slots__ = ("attrs", "at", "children", "end", "order", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, order: list[Element]) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        #: All elements of the page in document order; from `at` to before `end`, this one and its descendants.
        self.order, self.at = order, len(order)
        self.end = self.at + 1
        order.append(self)

    def walk(self) -> list[Element]:
        """This element and its descendants in document order."""
        return self.order[self.at : self.end]

    def select(self, *tags: str) -> list[Element]:
        return [e for e in self.order[self.at : self.end] if e.tag in tags]

    def has(self, *tags: str) -> bool:
        for e in self.order[self.at : self.end]:
            if e.tag in tags:
                return True
        return False

    def by_class(self, name: str) -> list[Element]:
        name = name.lower()
        return [e for e in self.order[self.at : self.end] if e.attrs and name in e.attrs.get("class", "").lower().split()]

    def text(self) -> str:
        """Text with white space collapsed; blocks and line breaks part words, inline neighbours don't."""
        only: Element | str = self
        while not isinstance(only, str) and len(only.children) == 1 and only.tag not in ("script", "style"):
            only = only.children[0]
        if isinstance(only, str) and _COLLAPSED.fullmatch(only):
            return only
        out: list[str] = []
        last = ""

        def add(s: str) -> None:
            nonlocal last
            for part in _spaced(s):
                if part == " " and (not out or last == " "):
                    continue
                out.append(part)
                last = part[-1]

        stack: list = [(self, False, False)]
        while stack:
            node, done, before_text = stack.pop()
            if isinstance(node, str):
                add(node)
            elif done:
                if before_text and node.tag in BLOCK and out and last != " ":
                    out.append(" ")
                    last = " "
            else:
                if node.tag in ("script", "style"):
                    continue
                if out and last != " " and (node.tag in BLOCK or node.tag == "br"):
                    out.append(" ")
                    last = " "
                sub: list = []
                for i, c in enumerate(node.children):
                    follows = i + 1 < len(node.children) and isinstance(node.children[i + 1], str)
                    sub.append((c, False, False))
                    if isinstance(c, Element):
                        sub.append((c, True, follows))
                stack.extend(reversed(sub))
        return "".join(out).strip(" ")

    def html(self) -> str:
        """Markup of the same tree."""
        out: list[str] = []
        stack: list[Element | str | tuple] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out.append(node[0])
            elif isinstance(node, str):
                out.append(escape(node, quote=False) if _SPECIAL.search(node) else node)
            else:
                if node.attrs:
                    out.append("<" + node.tag + "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items()) + ">")
                else:
                    out.append(f"<{node.tag}>")
                if node.tag in VOID:
                    continue
                stack.append((f"</{node.tag}>",))
                if node.tag in ("script", "style"):
                    stack.extend((c,) for c in reversed(node.children) if isinstance(c, str))
                else:
                    stack.extend(reversed(node.children))
        return "".join(out)


def _spaced(s: str) -> Iterator[str]:
    """Runs of other characters, and one space for each run of white space."""
    space = False
    for part in s.replace("\xa0", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" "):
        if space:
            yield " "
        if part:
            yield part
        space = True


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.order: list[Element] = []
        self.root = self.at = Element("#root", {}, None, self.order)

    def _close(self, tags, fences) -> None:
        e, last = self.at, None
        while e is not None and e.tag not in fences:
            if e.tag in tags:
                last = e
            e = e.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _ENDS_P:
            self._close(("p",), _FENCED)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        e = Element(tag, {}, self.at, self.order)
        for k, v in attrs:
            e.attrs.setdefault(k, v or "")
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs) -> None:
        # "<div/>" opens a div in HTML; only void elements end at once
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        e = self.at
        while e is not None and e.tag != tag:
            if e.tag in ("td", "th", "table", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "section", "article", "body", "html"):
                return
            if e.tag == "table" and tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                return
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data) -> None:
        kids = self.at.children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def _plain(html: str) -> _Builder | None:
    """The tree of a page of plain tags and text, or None: it holds something else."""
    start = html.find("<")
    tokens = _TOKEN.findall(html, start) if start >= 0 else []
    if start < 0 or sum([len(t[0]) for t in tokens]) != len(html) - start:
        return None
    b = _Builder()
    if start:
        b.handle_data(unescape(html[:start]))
    titled = False
    for _, tag, attrs, ended, data in tokens:
        if titled and ended != "title":
            return None
        if ended:
            titled = False
            b.handle_endtag(ended.lower())
        else:
            tag = tag.lower()
            titled = tag == "title"
            if tag in _RAW and not titled:
                return None
            b.handle_starttag(tag, [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else ())
        if data:
            b.handle_data(unescape(data) if "&" in data else data)
    return None if titled else b


def parse(html: str) -> Element:
    b = _plain(html)
    if b is None:
        b = _Builder()
        b.feed(html)
        b.close()
    for e in reversed(b.order):
        if e.parent is not None and e.parent.end < e.end:
            e.parent.end = e.end
    return b.root


def title(root: Element) -> str:
    found = next((e for e in root.walk() if e.tag == "title"), None)
    return " ".join("".join(c for c in found.children if isinstance(c, str)).split()) if found else ""

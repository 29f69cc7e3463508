"""Golden cases of table extraction: rows are given as `H a,b` or `D a{c=2,r=2}`, as header or data cells with spans."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftable.operators import dom
from weftable.operators.dom import parse, title
from weftable.operators.extract import PARTS, extract_article


def cell(tag: str, spec: str) -> str:
    text, _, rest = spec.partition("{")
    attrs = "".join(f' {"colspan" if k == "c" else "rowspan"}="{v}"' for k, v in re.findall(r"([cr])=([^,}]*)", rest))
    return f"<{tag}{attrs}>{text}</{tag}>"


def rows_html(spec: str) -> str:
    out = []
    for row in spec.split(";"):
        cells = []
        for part in row.strip().split(" + "):
            kind, _, items = part.partition(" ")
            cells += [cell("th" if kind == "H" else "td", x) for x in re.split(r",(?![^{]*})", items)]
        out.append("<tr>" + "".join(cells) + "</tr>")
    return "".join(out)


def article(table_rows: str) -> str:
    return f'<html><head><title>An article</title></head><body><section data-mw-section-id="1"><h2>Part</h2><table class="wikitable">{table_rows}</table></section></body></html>'


def run(spec: str, mode: str = "reference", raw: bool = False):
    found = extract_article(article(spec if raw else rows_html(spec)), mode)
    return found["sections"][0]["tables"], found["errors"]


def rows(t) -> list:
    return [[(c["column"], c["col_index"], c["value"]) for c in r["values"]] for r in t["rows"]]


def dist(t, level: int = -1) -> list:
    return [(c["name"], [(v["value"], v["count"]) for v in c["value_dist"]]) for c in t["header"][level]["columns"]]


def test_plain():
    (t,), _ = run("H A,B; D 1,2; D 1,3")
    assert rows(t) == [[("A", 0, "1"), ("B", 1, "2")], [("A", 0, "1"), ("B", 1, "3")]]
    assert dist(t) == [("A", [("1", 2)]), ("B", [("2", 1), ("3", 1)])]


def test_rowspan_takes_the_column_before_the_slot_search():
    (t,), _ = run("H A,B; D x{r=2},y; D z")
    assert rows(t) == [[("A", 0, "x"), ("B", 1, "y")], [("A", 0, "x"), ("A", 1, "z")]]
    assert dist(t) == [("A", [("x", 1), ("z", 1)]), ("B", [("y", 1)])]
    (t,), _ = run("H A,B; D x{r=2},y; D z", "corrected")
    assert rows(t)[1] == [("A", 0, "x"), ("B", 1, "z")]


def test_colspan():
    (t,), _ = run("H A,B; D x{c=2}; D p,q")
    assert rows(t) == [[("A", 0, "x"), ("A", 1, "x")], [("A", 0, "p"), ("B", 1, "q")]]
    assert dist(t) == [("A", [("p", 1), ("x", 1)]), ("B", [("q", 1)])]


def test_two_levels():
    (t,), _ = run("H Team{r=2},Result{c=2}; H W,L; D t1,1,2")
    assert dist(t, 0) == [("Team", [("t1", 1)]), ("Result", []), ("Result", [])]
    assert dist(t, 1) == [("Team", [("t1", 1)]), ("W", [("1", 1)]), ("L", [("2", 1)])]


def test_leaf_colspan_shares_a_histogram():
    (t,), _ = run("H N,P{c=2}; D a,b,c")
    assert dist(t) == [("N", [("a", 1)]), ("P", [("b", 1), ("c", 1)]), ("P", [("b", 1), ("c", 1)])]


def test_divider():
    (_, t), _ = run("H A,B; D a1,b1; H Part 2{c=2}; D a2,b2")
    assert rows(t) == [[("Part 2", 0, "a2"), ("Part 2", 1, "b2")]]
    assert dist(t)[0][1] == [("a2", 1), ("b2", 1)]
    (_, t), _ = run("H A,B; D a1,b1; H Part 2{c=2}; D a2,b2", "corrected")
    assert rows(t) == [[("A", 0, "a2"), ("B", 1, "b2")]]


def test_mixed_divider_inherits_data():
    (_, t), _ = run("H A,B; H r1 + D 1; H r2 + D 2; H P2{c=2}; H r3 + D 3")
    assert [[c["name"] for c in h["columns"]] for h in t["header"]] == [["A", "B"], ["P2", "P2"]]
    assert [[v for _, _, v in r] for r in rows(t)] == [["r1", "1"], ["r3", "3"]]


def test_data_only():
    (t,), _ = run("D A,B; D 1,2")
    assert rows(t) == [[("A", 0, "A"), ("B", 1, "B")], [("A", 0, "1"), ("B", 1, "2")]]
    assert dist(t)[0] == ("A", [("1", 1), ("A", 1)])


@pytest.mark.parametrize("spec", ["D a,b; D c,d; H P{c=2}; D e,f", "H A,B; D 1,2,3", "H A{c=2},B; H a1,a2; D 1,2,3", "H r + D 1,2", "H A,B; D x{c=50%},y", "H A,B; D x{c=},y"])
def test_tables_that_fail_are_errors(spec):
    _, errors = run(spec)
    assert len(errors) == 1 and errors[0]["reason"] and "<table" in errors[0]["html"]


def test_sub_tables_before_a_failure_stay():
    tables, errors = run("H A,B; D 1,2; H A,B; D 1,2,3")
    assert len(tables) == 1 and len(errors) == 1


def test_links():
    (t,), _ = run('<tr><th>A</th><th>B</th></tr><tr><td><a title="Foo">bar</a><a title="Baz">q</a></td><td><a>n</a></td></tr><tr><td><a title="Foo">x</a></td><td>m</td></tr>', raw=True)
    first = t["rows"][0]["values"][0]
    assert first["value"] == "barq" and first["structured_values"] == [{"structured": "Foo", "anchor": "bar"}, {"structured": "Baz", "anchor": "q"}]
    assert dist(t) == [("A", [("Foo", 2), ("Baz", 1)]), ("B", [("", 1), ("m", 1)])]


def test_footer():
    (a, b), _ = run("H A; D 1; H A")
    assert rows(a) == [[("A", 0, "1")]] and b["rows"] == [] and dist(b) == [("A", [])]


def test_zero_spans():
    (t,), _ = run("H A,B; D x{r=0},y")
    assert rows(t) == [[("B", 1, "y")]] and dist(t)[0] == ("A", [("x", 1)])
    (t,), _ = run("H A,B; D x{c=0},y")
    assert rows(t) == [[("A", 0, "y")]] and dist(t) == [("A", [("x", 1), ("y", 1)]), ("B", [])]


def test_both_spans():
    (t,), _ = run("H A,B,C; D x{c=2,r=2},1; D 2")
    assert rows(t) == [[("A", 0, "x"), ("A", 1, "x"), ("C", 2, "1")], [("A", 0, "x"), ("A", 1, "x"), ("A", 2, "2")]]
    assert dist(t) == [("A", [("2", 1), ("x", 1)]), ("B", []), ("C", [("1", 1)])]


def test_sections():
    table = '<table class="wikitable"><tr><th>A</th></tr><tr><td>1</td></tr></table>'
    html = f'<title>T</title><section data-mw-section-id="0">{table}</section><section><h2>Two</h2><section><h3>Three</h3>{table}</section></section><section>{table}</section><section><h2>None</h2></section>'
    found = extract_article(html)["sections"]
    assert [(s["section_ord"], s["section"], len(s["tables"])) for s in found] == [(0, "MAIN_SECTION", 1), (1, "Two", 1), (2, "Three", 1)]
    found = extract_article(html, dedupe=True)["sections"]
    assert [s["section"] for s in found] == ["MAIN_SECTION", "Three"]


def test_nested_tables():
    inner = '<table class="wikitable"><tr><td>1</td></tr></table>'
    found = extract_article(f'<section><h2>S</h2><table class="wikitable"><tr><td>{inner}</td></tr></table><div class="WikiTable"><table class="wikitable"><tr><td>2</td></tr></table></div></section>')
    assert [t["rows"][0]["values"][0]["value"] for t in found["sections"][0]["tables"]] == ["1", "2", "2"]


def test_empty_tables():
    assert run("", raw=True) == ([], [])
    tables, errors = run("<tr></tr>", raw=True)
    assert tables == [] and len(errors) == 1
    assert extract_article("") == {"entity": "", "sections": [], "errors": []}


def test_lenient_markup():
    root = parse("<table class=wikitable><tr><th>A<th>B<tr><td>1<td>2</table><p>x<p>y<br>z <b>bold")
    assert [len(r.select("td", "th")) for r in root.select("tr")] == [2, 2]
    assert [p.text() for p in root.select("p")] == ["x", "y z bold"]
    assert title(parse("<title> a\n b &amp; c</title>")) == "a b & c"
    deep = parse("<div>" * 5000 + "x")
    assert deep.text() == "x"


def state_machine(kinds: list[str]) -> list[int]:
    out, n, data = [], 0, False
    for k in kinds:
        if k == "h" and data:
            n, data = n + 1, False
        data = data or k == "d"
        out.append(n)
    return out


@given(st.lists(st.sampled_from("hd"), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_segmentation_follows_the_state_machine(kinds):
    kinds = ["h", *kinds]
    expected = state_machine(kinds)
    tables, errors = run("; ".join(f"{'H' if k == 'h' else 'D'} {i}" for i, k in enumerate(kinds)))
    assert not errors and len(tables) == expected[-1] + 1
    for n, t in enumerate(tables):
        assert [int(r["values"][0]["value"]) for r in t["rows"]] == [i for i, (k, e) in enumerate(zip(kinds, expected)) if e == n and k == "d"]


@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10))
@settings(max_examples=50, deadline=None)
def test_a_grid_without_spans_is_itself(columns, rows_, seed):
    data = [[f"{seed}-{i}-{j}" for j in range(columns)] for i in range(rows_)]
    (t,), _ = run("; ".join(["H " + ",".join(f"c{j}" for j in range(columns)), *("D " + ",".join(r) for r in data)]))
    assert [[v for _, _, v in r] for r in rows(t)] == data
    assert sum(n for _, d in dist(t) for _, n in d) == columns * rows_


PIECES = st.sampled_from(["<table class=\"wikitable\">", "</table>", "<tr>", "</tr>", "<td>", "<TD colspan=\"2\">", "</td>", "<th rowspan=\"2\">", "</th>", "<a title=\"t\">", "</a>", "<p>", "</p>", "<br>", "<li>", "<section>", "<title>", "</title>", "x", " ", "a  b", "&amp;", "&lt", "\xa0", "é\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_plain_pages_have_the_same_tree(html):
    """Tokens by one pattern against the standard library's."""
    found = dom._plain(html)
    other = dom._Builder()
    other.feed(html)
    other.close()
    if found is not None:
        seen = lambda b: [(e.tag, e.attrs, e.parent and e.parent.at, [c if isinstance(c, str) else c.at for c in e.children]) for e in b.order]
        assert seen(found) == seen(other)


def test_rendered_pages_are_plain():
    assert dom._plain(article(rows_html("H A,B; D x{c=2},y"))) is not None


@pytest.mark.parametrize("odd", ["<script>a<b</script>", "<!-- c -->", "a < b", "<b c=d>", "<br/>", "<title>a<b>c</title>", "<b c=\"&amp;\">", "x <", "no tag", "<title>"])
def test_other_pages_are_not(odd):
    assert dom._plain(odd) is None


def test_parts_of_tables():
    html = article(rows_html("H A,B; D 1,2; H E; D 3,4"))
    (whole,) = extract_article(html)["sections"]
    for part in PARTS:
        (some,) = extract_article(html, parts=(part,))["sections"]
        assert some["tables"] == [{k: None if k in PARTS and k != part else v for k, v in t.items()} for t in whole["tables"]]


@pytest.mark.parametrize(("markup", "text"), [("&quot;a&quot; &amp; b", '"a" & b'), ("cut off&amp", "cut off&"), ("cut off&am", "cut off&am")])
def test_titles_have_all_references_decoded(markup, text):
    """As the established parser does; the SQL of html_title knows only "&amp;"."""
    assert title(parse(f"<title>{markup}</title>")) == text

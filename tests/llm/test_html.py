import random
from html.parser import HTMLParser

import pytest

from tidemark.llm import html


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
        ("<h1>T</h1><p>x</p>y", "T\n\nx\n\ny"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("<ul><li>a<li>b</ul>", "- a\n- b"),
        ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<ol type=i><li>a<li>b</ol><ol type=A><li>c</ol>", "i. a\nii. b\n\nA. c"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
        ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("<table><tr><th>Name<th>Qty<tr><td>pie<td>3</table>", "Name  Qty\npie   3"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>22</table>", "r  1\n   22"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide  x\na  b  c"),
        ("<table>stray<tr><td>in</table>", "stray\n\nin"),
        ("<table><caption>C</caption><tfoot><tr><td>f</tfoot><tbody><tr><td>b</table>", "C\nb\nf"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("a<script>var x='</p>';</script>b<style>p{}</style>c<!-- d --><template>e</template><noscript>f</noscript>", "abc"),
        ("<title>t</title><p hidden>a<p>b<div style='display: none'>c</div>", "b"),
        ("<style>.x, #y { display:none } p.z{visibility:hidden}</style><i class='q x'>a</i><i id=y>b</i><p class=z>c <b style='visibility:visible'>d</b>", "d"),
        ("<details><summary>s</summary>h</details><details open><summary>t</summary>v</details>", "s\nt\nv"),
        ("a &amp; b &lt;c&gt; &copy;&nbsp;d < e", "a & b <c> © d < e"),
        ("<p>a</div></p>b</p>c", "a\n\nb\n\nc"),
        ("<a href=\"x>y\" title='<b>'>l</a>", "l"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"),
        ("<blockquote>q</blockquote>", "    q"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<textarea>\n<b>x</textarea>", "<b>x"),
        ("<p>a\x00b퟿", "a\x00b퟿"),
        ("<", "<"),
        ("<b", "<b"),
        ("x<br/>y<br></br>z", "x\ny\n\nz"),
        ("<table><tr><td>漢字<td>a<tr><td>b<td>c</table>", "漢字  a\nb     c"),
    ],
)
def test_rendering(page, text):
    assert html.render(page) == text


class Words(HTMLParser):
    """Visible words of well-formed pages, told apart by another parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words, self.stack = 0, [], []

    def handle_starttag(self, tag, attrs):
        bad = tag in ("script", "style") or "hidden" in dict(attrs)
        self.stack.append(bad)
        self.hidden += bad

    def handle_endtag(self, tag):
        self.hidden -= self.stack.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


@pytest.mark.parametrize(
    "sheet,text",
    [
        ("@media print { nav { display:none } }", "a b"),
        ("@media (max-width:767px){ .x{display:none} nav{display:none} } b{display:none}", "a"),
        ("@media screen { nav { display:none } }", "b"),
        ("@media print, only screen { nav { display:none } } b { color:red }", "b"),
        ("@media all { @media print { nav{display:none} } b{display:none} }", "a"),
        ("@media print { @media all { nav{display:none} } b{display:none}", "a b"),
        ("@media all {" * 5000 + "}} nav{display:none}", "b"),
    ],
)
def test_media_blocks(sheet, text):
    assert html.render(f"<style>{sheet}</style><nav>a </nav><b>b</b>").split() == text.split()


def test_all_visible_words_stand_in_order():
    rng, number = random.Random(4), iter(range(10**6))

    def node(depth, inside):
        if depth == 0 or rng.random() < 0.3:
            return f" w{next(number)} "
        kinds = ["div", "b", "span", "section", "i", "ul", "table"] + (["p", "h2"] if inside != "p" else [])
        kind = rng.choice(kinds if inside not in ("p", "h2", "b", "i", "span") else ["b", "span", "i"])
        hide = rng.choice(["", "", "", " hidden", " class=x"])
        inner = lambda k=kind: "".join(node(depth - 1, k if k in ("p", "h2", "b", "i", "span") else inside) for _ in range(rng.randint(1, 3)))
        if kind == "ul":
            return f"<ul{hide}>" + "".join(f"<li>{inner()}</li>" for _ in range(2)) + "</ul>"
        if kind == "table":
            return f"<table{hide}>" + "".join("<tr>" + "".join(f"<td>w{next(number)}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
        return f"<{kind}{hide}>{inner()}</{kind}><script>var w = 1;</script>"

    for _ in range(300):
        page = "".join(node(4, "") for _ in range(3))
        words = Words()
        words.feed(page)
        got = [w for w in html.render(page).split() if w != "-"]
        assert got == words.words, page


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<table><tr><td>" * 300 + "x", "<ul><li>" * 3000 + "x", '<b a="' * 3000, "<p><b>" * 5000, "<table>x" * 2000, "<a><div>" * 3000, "<td colspan=1000 rowspan=60000>x" * 50, "<table><tr>" + "<td colspan=1000 rowspan=0>x" * 50, "<!--" * 5000, "</p>" * 5000, "<table><tr><td>x<td>" * 3000, "<ul><li>x" * 20_000, "".join(f"<table><tr><td colspan={k}><td>x</table>" for k in range(1000)), "".join(f"<tr><td colspan={k} rowspan={9000 - k}>x" for k in range(1, 3000))])
def test_odd_pages_end(page):
    assert isinstance(html.render(page), str)


def test_spans_take_little_memory():
    import tracemalloc

    page = "<table>" + "<tr><td colspan=1000 rowspan=0>x" * 2500
    assert len(page) > 80_000
    tracemalloc.start()
    text = html.render(page)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    lines = text.split("\n")
    assert len(lines) == 2500 and all(line.strip() == "x" for line in lines)
    assert [len(line) for line in lines[:3]] == [1, 4, 7] and max(map(len, lines)) == 1001


def test_no_caps():
    """Wide spans, long numbers and deep tables are laid out like any others."""
    assert html.render("<table><tr><td colspan=5000>a<td>b<tr><td>c<td colspan=4999>d<td>e</table>") == "a     b\nc  d  e"
    assert html.render("<ol start=123456789012><li>x</ol>") == "123456789012. x"
    assert html.render("<ol start=99999999999999999999><li>x</ol>") == html.render(f"<ol start={'9' * 6000}><li>x</ol>") == "1. x"
    deep = "x<td>y"
    for _ in range(60):
        deep = f"<table><tr><td>a<td>{deep}</table>"
    lines = [line for line in html.render(deep).split("\n") if line.strip()]
    assert lines[-1].endswith("x  y") and lines[-1].index("x") == 3 * 60


@pytest.mark.parametrize("rows", [3, 4000])
def test_alignment_is_the_same_at_every_size(rows):
    page = "<table>" + "<tr><td>name<td>k<td>1" * rows + "<tr><td>a longer name<td>v<td>2" + "<tr><td>" + "long " * 300 + "<td>w<td>3"
    first, last = html.render(page).split("\n")[0], html.render(page).split("\n")[-1]
    assert first == "name  k  1" and last == "long " * 299 + "long  w  3"
    assert html.render(page, width=2000).split("\n")[0] == "name" + " " * 1497 + "k  1"


def test_numbers_against_integers():
    for text, want in [("7", 7), (" -3x", -3), ("+0012", 12), ("000000000000000000000000005", 5), ("x", 9), ("", 9), ("-", 9), ("1" * 18, int("1" * 18)), ("1" * 19, 9), (None, 9), ("0", 0)]:
        assert html._int(text, 9) == want, text


def test_extract(spark):
    rows = [(1, "u", "<p>a"), (2, None, None), (None, "x", ""), (1, "u", "<p>a"), (3, "l", "<p>word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as text", "1 as `a.b`")
    got = sorted(((r["page_id"], r["text"]) for r in html.extract(df).collect()), key=str)
    assert got == sorted(((i, html.render(t or "")) for i, _, t in rows), key=str)
    assert html.extract(df.limit(0)).collect() == []

"""Pages as elements, against generated trees, the standard library's events and cases by hand."""

import html
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forecourt.sources import markup, pages
from forecourt.sources.pages import Select

WANTED = frozenset(["class", "title", "data-x"])
text = st.text("ab &<>\"'é\n\U0001f600;", max_size=8)
name = st.sampled_from(["div", "span", "b", "section", "em", "article", "x-tag"])
quote = st.sampled_from(['"', "'", ""])
attributes = st.lists(st.tuples(st.sampled_from(["class", "TITLE", "data-x", "id"]), text, quote,
                                st.sampled_from([" ", "\n ", "  / "])), max_size=3)
void = st.sampled_from(["<br>", "<BR/>", "<img src=a.png alt='</div>'>", "<input disabled>", "<!-- <b> -->",
                        "<script>'</div><b>'</script>", "<hr class='y'>"])
tree = st.recursive(st.one_of(text.map(lambda t: ("text", t)), void.map(lambda v: ("void", v))),
                    lambda inner: st.tuples(name, attributes, st.lists(inner, max_size=4)), max_leaves=14)


def written(node, out, elements):
    """Append the markup of a node and, in order of start tags, the elements; gives the visible text."""
    if node[0] == "text":
        out.append(html.escape(node[1], quote=False))
        return node[1]
    if node[0] == "void":
        out.append(node[1])
        lower = node[1].lower()
        if not lower.startswith("<!--"):
            tag = lower[1:].rstrip("/>").split(">")[0].split()[0].rstrip("/")
            own = {"class": "y"} if tag == "hr" else {}
            elements.append([tag, "\n" if tag == "br" and False else "", own, 0])
        return "\n" if lower.startswith("<br") else ""
    tag, given_attributes, children = node
    found, marks = {}, []
    for key, value, mark, gap in given_attributes:
        plain = mark == "" and value and not set(value) & set(" \n\"'<>&`=;")
        if mark == "" and not plain:
            mark = '"'
        shown = value if plain else mark + html.escape(value) + mark
        marks.append(f"{gap}{key}={shown}")
        if key.lower() in WANTED:
            found.setdefault(key.lower(), value)
    out.append(f"<{tag}{''.join(marks)}>" if not marks or not marks[-1].endswith("/") else f"<{tag}{''.join(marks)} >")
    elements.append(own := [tag, None, found, len(elements)])
    own[1] = "".join(written(c, out, elements) for c in children)
    own[3] = len(elements) - own[3] - 1
    out.append(f"</{tag.upper()} >")
    return own[1]


@settings(max_examples=300, deadline=None)
@given(st.lists(tree, max_size=4))
def test_generated_trees(nodes):
    out, elements = [], []
    visible = "".join(written(n, out, elements) for n in nodes)
    got_text, got = markup.parse("".join(out), WANTED)
    assert got_text == visible
    assert [[tag, got_text[a:b], found, last - first - 1] for tag, first, last, a, b, found in got] == elements
    assert [e[1] for e in got] == list(range(len(got)))


class Events(HTMLParser):
    def __init__(self):
        super().__init__()
        self.starts = []

    def handle_starttag(self, tag, attrs):
        self.starts.append((tag, {k: v or "" for k, v in reversed(attrs) if k in ("class", "href", "lang")}))


def test_saved_pages_have_the_start_tags_that_the_standard_library_sees(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        events = Events()
        events.feed(r["html"])
        _, got = markup.parse(r["html"], frozenset(["class", "href", "lang"]))
        assert [(e[0], e[5]) for e in got] == events.starts


@pytest.mark.parametrize("page, want", [
    ("<p>a<p>b<div>c</div>d", ["a", "b", "c"]),  # a paragraph ends where a block starts
    ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", ["abcd", "abc", "b", "b", "d"]),
    ("<table><tr><td>a<td>b<table><tr><td>c</table>d<tr><td>e</table>",
     ["abcde", "abcd", "a", "bcd", "c", "c", "c", "e", "e"]),
    ("<div><span>a</div>b</span>c", ["a", "a"]),  # a block's end closes what is open in it
    ("<span>a<div>b</span>c</div>d</span>e", ["abcd", "bc"]),  # an inline end stays in its block
    ("</b></div>a<b>b</i>c</b>", ["bc"]),
    ("a < b <3 <b>c</b> & &amp; &lt;i&gt; &nope; &eacute", ["c"]),
    ("<b title='>'>x</b><b title=it's>y</b>", ["x", "y"]),
    ("<textarea><b>&amp;</textarea><b>x", ["<b>&", "x"]),
    ("<script>a</script ><style>b</style><title>c</title>d<b", ["", "", ""]),
    ("<b>cut <i clas", ["cut "]), ("<script>never closed <b>x</b>", [""]), ("<!-- open <b>", []), ("", []),
    ("<B CLASS=a class=b>x</B>", ["x"]),
])
def test_cases(page, want):
    visible, got = markup.parse(page, WANTED)
    assert [visible[e[3]:e[4]] for e in got] == want
    if page.startswith("<B"):
        assert got[0][5] == {"class": "a"}


def test_long_and_hostile_pages_take_linear_time():
    for page in ["<" * 200_000, "<a " * 60_000, '<a b="' * 40_000, "<div>" * 50_000, "</p>" * 60_000,
                 "<b>" * 30_000 + "</i>" * 200, "<a" + " x=1" * 60_000, "x" * 2_000_000]:
        markup.parse(page, WANTED)


def test_selectors(spark):
    page = ("<div class='a b'><span data-x='one two'>1</span><div class=ab><span>2</span></div></div>"
            "<section><div class=b><span data-x>3</span></div></section>")
    rows = [(1, page), (2, None), (3, ""), (4, page.replace("div", "DIV"))]
    df = spark.createDataFrame(rows, "id int, html string")

    def texts(block, field):
        found = pages.extract_records(df, "html", ["id"], pages.PageRules((block,), text=(field,)))
        return {i: [r["text"] for r in found.where(f"id = {i}").orderBy("pos").collect()] for i in (1, 2, 3, 4)}
    assert texts(Select("div", cls="b"), Select("span")) == {1: ["1", "3"], 2: [], 3: [], 4: ["1", "3"]}
    assert texts(Select("div", attribute="class", part="b"), Select("span"))[1] == ["1", "2", "3"]
    assert texts(Select("div"), Select("span", attribute="data-x"))[1] == ["1", "3"]
    assert texts(Select("div"), Select("span", attribute="data-x", part="two"))[1] == ["1"]
    assert texts(Select("span", inside=Select("section")), Select(itself=True))[4] == ["3"]
    assert texts(Select("nav"), Select("span"))[1] == []

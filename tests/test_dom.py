"""Parser, serializer, selectors, Markdown and URL resolution on hand-made pages."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators import dom
from pagemill.operators.markdown import to_markdown, with_citations
from pagemill.operators.page import Filters, fetched_title, images, links, needs_browser, open_graph, parse_one, parts, strip_tags, tag_sequence, visible_text
from pagemill.operators.selectors import SelectorError, select
from pagemill.operators.urls import resolve


def html(s: str) -> str:
    return dom.serialize(dom.body(dom.parse(s)), inner=True)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<ul><li>1<li>2<ul><li>n</ul></ul>", "<ul><li>1</li><li>2<ul><li>n</li></ul></li></ul>"),
        ("<p><b>x</p><p>y", "<p><b>x</b></p><p><b>y</b></p>"),
        ("a</p>b", "a<p></p>b"),
        ("<br/>x<img src=a>", '<br/>x<img src="a"/>'),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"),
        ("<script>var t='</p>';</script>x", "<script>var t='</p>';</script>x"),
        ("&lt;a&gt; &amp; \"q\" 'r'", "&lt;a&gt; &amp; &#34;q&#34; &#39;r&#39;"),
        ("<div id=1 class='a b'>", '<div id="1" class="a b"></div>'),
        ("<!-- c --><p>x<!", "<p>x</p>"),
        ("", ""),
        ("<p>x <a", "<p>x </p>"),
    ],
)
def test_trees(source, expected):
    got = html(source) if not source.startswith("<script") else dom.serialize(dom.parse(source)).replace("<html><head>", "").replace("</head><body>", "").replace("</body></html>", "")
    assert got == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ab=\"' !-pdivtr&;\n", max_size=80))
def test_parser_never_raises_and_settles(source):
    once = dom.serialize(dom.parse(source))
    assert dom.parse(once).text() is not None
    parse_one(source, "http://a.example/", Filters())


def test_tokens_need_no_tree():
    assert tag_sequence("<html><head><title>t</title></head><body><div><p>x</p></div><br/></body>") == ["html", "head", "title", "body", "div", "p", "br"]
    assert tag_sequence("plain") == [] and tag_sequence("<p><di") == ["p"]
    assert fetched_title("<title> a &amp; b </title>") == "a & b" and fetched_title("<title></title>x") == "" and fetched_title("x") == ""
    assert visible_text("<head><title>t</title></head><body>a<script>s</script> b <noscript>n</noscript></body>") == "a b "
    assert strip_tags("<p>a</p><script>s</script>") == "as"


def test_selectors():
    root = dom.parse('<div id=x class="a b"><p>1</p><p data-k="v-1">2</p><span>s</span></div><p>3</p>')
    texts = lambda s: [n.text() for n in select(root, s)]
    assert texts("#x > p") == ["1", "2"] and texts(".a.b p:first-child") == ["1"] and texts("p:nth-child(2n)") == ["2", "3"]
    assert texts("p + span") == ["s"] and texts("p ~ span, body > p") == ["s", "3"] and texts('p[data-k^="v"]') == ["2"] and texts("p[data-k|=v]") == ["2"]
    assert texts("p:not([data-k]):contains(1)") == ["1"] and texts("div:has(span) span") == ["s"] and texts("p:last-child") == ["3"]
    for bad in ("", "div[[", "p:unknown", "> p", "p:nth-child(x)"):
        with pytest.raises(SelectorError):
            select(root, bad)


def test_filters():
    page = "<div class=k><p>a</p></div><nav>n</nav><div class=k><div class=k>in</div></div>"
    assert Filters(css_selector=".none").apply(page) == page
    assert Filters(css_selector=".k").apply(page).count("in") == 2  # nested matches each count
    assert "n" not in Filters(exclude=("nav",)).apply(page).replace("in", "").replace("<div", "").split("body")[1]
    assert Filters(include=("nav", "p")).apply(page) == "<p>a</p><nav>n</nav>"
    assert "<nav>" in Filters(include=("p", "[[")).apply(page)  # one bad include voids the group
    assert Filters().apply(page) == page


@pytest.mark.parametrize(
    ("ref", "base", "full"),
    [
        ("/b", "http://a.example/x/y", "http://a.example/b"),
        ("c", "http://a.example/x/y", "http://a.example/x/c"),
        ("../c", "http://a.example/x/y/z", "http://a.example/x/c"),
        ("#f", "http://a.example/x?q=1#g", "http://a.example/x?q=1#f"),
        ("//h.example/p", "https://a.example/", "https://h.example/p"),
        ("/è", "http://a.example/", "http://a.example/%C3%A8"),
        ("mailto:x@y", "http://a.example/", "mailto:x@y"),
    ],
)
def test_resolve(ref, base, full):
    assert resolve(ref, base) == full


def test_harvest():
    root = dom.parse('<a href="/a"> x </a><a href="/a">again</a><a href="http://A.example/b">b</a><a href="https://o.example/">o</a><a href="mailto:a@b">m</a><a href="">e</a><a>n</a><a href="#f">f</a><img src="i.png" alt=" d "><img src="i.png"><img src="data:x"><meta property="og:title" content="1"><meta property="og:title" content="2"><meta property="og:type" content="">')
    got = links(root, "http://a.example/p")
    assert [x["href"] for x in got["internal"]] == ["http://a.example/a", "http://A.example/b", "http://a.example/p#f"] and got["internal"][0]["text"] == "x"
    assert [x["href"] for x in got["external"]] == ["https://o.example/"] and links(root, "") == {"internal": [], "external": []}
    assert images(root, "http://a.example/p") == [{"src": "http://a.example/i.png", "alt": "d"}]
    assert open_graph(root) == {"title": "2", "description": "", "image": "", "type": ""}


def test_parts_measure_bytes():
    (one,) = parts(dom.parse("<div id=i class=c> é <a href=x>ab</a></div>"))
    assert (one["tag"], one["class"], one["id"], one["text_len"], one["link_len"]) == ("div", "c", "i", len("é ab".encode()), 2)
    assert one["html_len"] == len(one["html"].encode())


def test_needs_browser():
    long = "<body>" + "word " * 60
    assert needs_browser("<body>short</body>") and not needs_browser(long)
    assert needs_browser(long + '<div id="root"></div>') and needs_browser(long + "<noscript>Please enable  JavaScript</noscript>")


def test_markdown():
    md = to_markdown(dom.body(dom.parse("<h2>T</h2><p>a <b>b</b> <i>c</i> <code>d</code></p><ol><li>x<li>y</ol><blockquote><p>q</p></blockquote><pre><code class=language-py>z\n</code></pre><hr><table><tr><th>h</th></tr><tr><td>1|2</td></tr></table><script>no</script>")), "http://a.example/")
    assert md == "## T\n\na **b** *c* `d`\n\n1. x\n2. y\n\n> q\n\n```py\nz\n```\n\n* * *\n\n| h |\n|---|\n| 1\\|2 |"


def test_citations():
    assert with_citations("no links") == "no links"
    assert with_citations("[a](u) ![i](v) [b](u)") == "[a][1] ![i][2] [b][1]\n\n---\n[1]: u\n[2]: v"


def test_readability_finds_the_article():
    text = "The quick brown fox, which is quick, jumps over the lazy dog again and again. " * 4
    page = f"<title>T</title><meta name=author content=A><div class=sidebar><p>{text}</p></div><article><h1>T</h1><p>{text}</p><p>{text}</p></article><footer>legal</footer>"
    got = parse_one(page, "http://a.example/", Filters())
    assert got["readable"] and "jumps over" in got["article_text"] and "legal" not in got["article_text"] and got["meta"]["author"] == "A" and got["meta"]["title"] == "T"
    short = parse_one("<p>x</p>", "http://a.example/", Filters())
    assert not short["readable"] and short["article_html"] == "<p>x</p>"

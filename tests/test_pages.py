from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions import urls
from millrace.functions.errors import NotFound, NotSupported
from millrace.functions.registry import FUNCTIONS
from millrace.operators import article, html_api, robots, sitemap, xpath
from millrace.operators.cssx import compile_pipeline, evaluate, to_date, to_number
from millrace.operators.dom import parse, serialise
from millrace.operators.selectors import SelectorError, select

LISTING = parse("<table>" + "".join(f'<tr><td><input class="ListingId" value="{v}"></td></tr>' for v in ["068728", "068728", *(f"{k:06d}" for k in range(38))]) + "</table>")


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        (":value(:first(.ListingId))", ["068728"]),
        (":count(.ListingId)", [40]),
        (':count(:attr("missing", .ListingId))', [40]),
        (':count(:compact(:attr("missing", .ListingId)))', [0]),
        (":count(:distinct(:value(.ListingId)))", [39]),
        (":one(:first(.ListingId))", [True]),
        (":one(.ListingId)", [False]),
        (':count(:has(".ListingId", tr))', [40]),
        (':count(:matches(".ListingId", input))', [40]),
        (':count(:not(".ListingId", input))', [0]),
        (':count(:within("tr", .ListingId))', [40]),
        (':count(:closest("tr", .ListingId))', [40]),
        (':count(:children("input", td))', [40]),
        (":count(:siblings(tr))", [1560]),
        (":count(:distinct(:siblings(tr)))", [40]),
        (":count(:next(tr))", [39]),
        (":count(:prev(tr))", [39]),
        (':count(:matches("[", input))', [0]),
        (':count(:not("[", input))', [0]),
        (':count(:withText("[", td))', [0]),
        (":toNumber(:value(:first(.ListingId)))", [68728]),
        (":slice(-2, 5, :value(input))", ["000036", "000037"]),
        (":take(0, input)", []),
        (":skip(39, :value(input))", ["000037"]),
        (':indexOf("000000", :value(input))', [2]),
        (':join(",", :take(2, :attr("none", input)))', [","]),
        ("input >> :attr('value') >> :take(1) >> :len()", [1]),
        (":nth(1.5, input)", []),
        (":last(:value(input))", ["000037"]),
    ],
)
def test_pipelines(text, wanted):
    assert evaluate(LISTING, text) == wanted


def test_pipeline_errors():
    for bad in (":take(a)", ":nosuch(a)", "a >> [", ":first(a"):
        with pytest.raises(SelectorError):
            compile_pipeline(bad)


def test_maps():
    d = parse('<p>\xa0a  b </p><a href="/q?x=1#f">l</a><input checked value=v><b>one</b><p title="1.234,5">t<i>u</i></p>')
    one = lambda q: evaluate(d, q, "http://u@h.com:8/a/b")[0]
    assert one(":normalize(:text(:first(p)))") == "a b"
    assert one(':prop("checked", input)') is True and one(':prop("disabled", input)') is False
    assert one(':parseUrl(:url("href", a))') == {"href": "http://u@h.com:8/q?x=1#f", "protocol": "http:", "username": "u", "password": "", "host": "h.com:8", "hostname": "h.com", "port": "8", "pathname": "/q", "search": "?x=1", "hash": "#f", "origin": "http://h.com:8"}
    assert evaluate(d, ':ownText(:last(p))') == ["t"] and evaluate(d, ":html(:last(p))") == ["t<i>u</i>"]
    assert evaluate(d, r':regex("(\\w)(\\w)", 2, :text(b))') == ["n"] and evaluate(d, r':regex("zz", :text(b))') == [None]
    assert evaluate(d, ':replace("(o)(n)", "$2$1", :text(b))') == ["noe"] and evaluate(d, ':replace("[", "x", :text(b))') == ["one"]


@pytest.mark.parametrize(("text", "wanted"), [("1,234.5", 1234.5), ("1,234", 1234), ("1,5", 1.5), ("$ 12", 12), ("1,234,567", 1234567), ("x", None), ("-3e2", -300)])
def test_numbers(text, wanted):
    assert to_number(text) == wanted


@pytest.mark.parametrize(("text", "layout", "wanted"), [("2024-03-01T10:00:00+02:00", None, "2024-03-01T08:00:00Z"), ("2024-03-01", None, "2024-03-01T00:00:00Z"), ("Mar 1, 2024", None, "2024-03-01T00:00:00Z"), ("01/03/2024", "02/01/2006", "2024-03-01T00:00:00Z"), ("2024-03-01T10:00:00.5Z", None, "2024-03-01T10:00:00.5Z"), ("no", None, None)])
def test_dates(text, layout, wanted):
    assert to_date(text, layout) == wanted


def test_tree_repairs():
    d = parse("<p><b>x<br><p>y</p><ul><li>1<li>2</ul><table><tr><td>a<td>b</table><script>var t='</p>'</script><!-- <p> -->")
    assert [n.text() for n in select(d, "li")] == ["1", "2"] and len(select(d, "td")) == 2 and len(select(d, "p")) == 2
    assert len(select(parse("<div>" * 5000 + "x"), "div")) == 5000


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/ab c\"'=!-p&;", max_size=60))
def test_any_text_parses(text):
    again = parse(serialise(parse(text)))
    assert isinstance(serialise(again), str)
    assert article.extract(text)["title"] is None or isinstance(article.extract(text)["title"], str)


def test_selectors():
    d = parse('<div id=a class="x y"><p lang=en-US>1</p><p>2</p><span data-k="v w">3</span></div>')
    for css, n in [("div > p", 2), ("p + p", 1), ("p ~ span", 1), ("#a.x.y", 1), ("[data-k~=w]", 1), ("[lang|=en]", 1), ("p:nth-child(2n)", 1), ("p:not(:first-child)", 1), ("div:has(> span)", 1), ("p, span", 3), ("p:contains('2')", 1), ("*", 7)]:
        assert len(select(d, css)) == n, css


def test_xpath():
    d = parse("<div id=a><p class=x>one</p><p>two <b>2</b></p><ul><li>1<li>2<li>3</ul></div>")
    assert xpath.evaluate(d, "count(//li)") == 3 and xpath.evaluate(d, "//li[last()]/text()") == ["3"] and xpath.evaluate(d, "//p[@class='x']/@class") == ["x"]
    assert xpath.evaluate(d, "//p[contains(., 'two')]/b/text()") == ["2"] and xpath.evaluate(d, "sum(//li) div 2") == 3 and xpath.evaluate(d, "//b/ancestor::div/@id") == ["a"]
    with pytest.raises(xpath.XPathError):
        xpath.evaluate(d, "//p[")


def test_page_functions():
    page = html_api.html_parse('<html><head><base href="/x/"><title>T</title></head><body><p id=p style="color: red; width: 3">a</p><p>b</p></body></html>', "http://h/a")
    assert html_api.base_url(page) == "http://h/x/" and html_api.resolve_url(page, "y") == "http://h/x/y"
    p = html_api.element(page, "p")
    assert html_api.style_get(p, "width", "color") == {"width": 3.0, "color": "red"}
    html_api.style_set(p, "height", 2)
    html_api.style_remove(p, "width")
    assert "width" not in p.attrs["style"] and "height: 2;" in p.attrs["style"]
    html_api.attr_set(p, {"a": "1"})
    html_api.attr_remove(p, "id")
    assert html_api.attr_get(p, "a", "id") == {"a": "1"}
    assert html_api.inner_text(page, "p") == "ab" and html_api.inner_html(page, "p") == "a" and html_api.inner_text_all(page, "p") == ["a", "b"]
    html_api.inner_html_set(page, "p", "<i>z</i>")
    html_api.inner_text_set(page, "p + p", "<q>")
    assert html_api.inner_html_all(page, "p") == ["<i>z</i>", "&lt;q&gt;"]
    with pytest.raises(NotFound):
        html_api.inner_text(page, "h9")
    assert html_api.query_one(page, ":count(p)") == 2 and html_api.query_exists(page, "h9") is False and html_api.query_value(page, "count(//p)", "xpath") == 2
    assert html_api.properties(p)["nextElementSibling"].tag == "p" and html_api.properties(page)["title"] == "T"


def test_every_function_is_there():
    assert len(FUNCTIONS) == 160
    with pytest.raises(NotSupported):
        FUNCTIONS["CLICK"]("x")


def test_robots():
    d = robots.parse("User-agent: a\nUser-agent: B\nDisallow: /x\nAllow: /x/y*z$\nUser-agent: *\nDisallow: /\nSitemap: http://h/s.xml\nHost: h")
    assert [g["userAgents"] for g in d["groups"]] == [["a", "B"], ["*"]]
    assert robots.match(d, "/x/yyz", "b") == {"allowed": True, "directive": "allow", "pattern": "/x/y*z$", "userAgent": "B"}
    assert not robots.allows(d, "/q", "zz") and robots.allows(d, "/robots.txt", "zz") and robots.allows(d, "/q", "A")
    assert not robots.allows(d, "http://h/%78?a#b", "a") and robots.sitemaps(d) == ["http://h/s.xml"]
    tie = robots.parse("User-agent: *\nDisallow: /a\nAllow: /a")
    assert robots.match(tie, "/a")["directive"] == "allow"


BODIES = {
    "i": "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>i</loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>",
    "a": "<urlset><url><loc>u1</loc><priority>0.5</priority></url><url><loc>u2</loc></url></urlset>",
    "b": '<x:urlset xmlns:x="q"><x:url><x:loc>u1</x:loc></x:url><x:url><x:loc>u3</x:loc></x:url></x:urlset>',
}


def test_sitemaps(spark):
    get = BODIES.__getitem__
    assert [u["loc"] for u in sitemap.urls("i", get)] == ["u1", "u2", "u3"]
    assert [u["loc"] for u in sitemap.urls("i", get, {"dedupe": False})] == ["u1", "u2", "u1", "u3"]
    assert sitemap.urls("i", get, {"recursive": False}) == []
    for bad in ("<urlset><url></url></urlset>", "<urlset><url><loc>a</loc><priority>x</priority></url></urlset>", "<urlset><url><loc>a<b/></loc></url></urlset>", "<x/>"):
        with pytest.raises(sitemap.SitemapError):
            sitemap.parse(bad)
    with pytest.raises(sitemap.SitemapError):
        sitemap.urls("i", get, {"maxDepth": 0})
    with pytest.raises(ValueError):
        sitemap.urls("i", get, {"depth": 1})
    table = spark.createDataFrame(list(BODIES.items()), "url string, body string")
    assert [r.loc for r in sitemap.walk_table(table, "i", 2).orderBy("place").collect()] == ["u1", "u2", "u3"]


def test_article():
    body = "<p>" + "Some words of a long paragraph that tells a story about it all. " * 5 + '<a href="/x">link</a> <a href="javascript:x">bad</a></p>'
    r = article.extract(f"<html lang=en><head><title>My Great Piece | The Site</title><meta name=author content='By Ann'><meta property='article:tag' content=x></head><body><nav><a href=/>home</a></nav><main><article><h1>My Great Piece</h1><p class=byline>By Ann B</p><time datetime=2024-03-01T10:00:00Z>March</time>{body * 2}<h2>Sub</h2><ul><li>a<li>b</ul><div class=related><a href=/r>Related</a></div></article></main></body></html>", "http://h.com/a/")
    assert (r["title"], r["byline"], r["siteName"], r["lang"], r["publishedAt"], r["tags"], r["readingTimeMinutes"]) == ("My Great Piece", "Ann", "The Site", "en", "2024-03-01T10:00:00Z", ["x"], 1)
    assert r["wordCount"] > 40 and "Related" not in r["text"] and "javascript" not in r["html"] and "[link](http://h.com/x)" in r["markdown"] and "## Sub" in r["markdown"] and "My Great" not in r["text"]
    assert article.extract("")["text"] is None


def test_article_functions_extract_once(monkeypatch):
    done, whole = [], article._extract
    monkeypatch.setattr(article, "_extract", lambda root, url: done.append(url) or whole(root, url))
    markup = "<article><h1>Once</h1>" + "<p>Some words of a paragraph that is read once for three functions.</p>" * 9 + "</article>"
    found = FUNCTIONS["WEB::ARTICLE::EXTRACT"](markup, "http://h/")
    found["tags"], found["text"] = ["changed"], "changed"
    assert FUNCTIONS["WEB::ARTICLE::TEXT"](markup, "http://h/").startswith("Some words") and FUNCTIONS["WEB::ARTICLE::MARKDOWN"](markup, "http://h/").startswith("Some words")
    assert done == ["http://h/"] and FUNCTIONS["WEB::ARTICLE::EXTRACT"](markup, "http://i/")["title"] == "Once" and done == ["http://h/", "http://i/"]


def test_urls():
    assert urls.absolute("http://h/a/", "b") == "http://h/a/b" and urls.absolute(None, "b") is None and urls.parts("/rel") is None
    assert urls.base_url("http://h/a", "javascript:x") == "http://h/a"

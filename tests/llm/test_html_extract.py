import html
import json
import re
from collections import Counter

import pytest

from cohortry.llm.html_extract import SEVERAL, align, containers, extract, extract_main_text, fold, infer_wrappers, host_of, page_expression
from cohortry.llm.registry import QUERIES

RICH = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body class="post sidebar">
<header><a href="/">Site</a></header><nav>Menu</nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="content"><article class="post-12"><header><h1>The &amp; Title</h1></header>
<p>First <b>bold</b>, <span class="ad">Buy now</span>
   <em title="hidden id" aria-hidden="false">and</em>&nbsp;more.<p>Second<br>line &lt;x&gt; 3 < 4
<div class="ad-slot">Buy</div><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>
<p style="display: none">unseen</p><ol class="commentlist"><li>me too</ol><form>Your name <input name=n></form><!-- <p>hidden</p> --><noscript>none</noscript>
<section id="comments"><article class="comment"><p>Nice!</p></article></section></article></div>
<aside><p>Related things that are much longer than the article itself, again and again and again and again.</p></aside></div>
<footer>&copy; site</footer></body></html>"""
RICH_TEXT = "The & Title\nFirst bold, and more.\nSecond line <x> 3 < 4\none\ntwo\na\nb\nc"
PLAIN_DIVS = """<body><div class="menu">Home</div><div id=wrap><div class=entry><h2>Head</h2><p>Text of some length, so that it weighs.</div></div>
<div class="footer">foot</div>"""


def levels_of(*pages):
    wrapper, mass = None, Counter()
    for p in pages:
        nodes, m = page_expression(p)
        wrapper = nodes if wrapper is None else align(wrapper, nodes)
        mass.update(m)
    return containers(wrapper, mass)


def test_main_text():
    assert extract(RICH, levels_of(RICH)) == RICH_TEXT
    assert extract(PLAIN_DIVS, levels_of(PLAIN_DIVS)) == "Head\nText of some length, so that it weighs."
    # A host of both: each page is read by the level that it fills.
    both = levels_of(RICH, PLAIN_DIVS)
    assert extract(RICH, both) == RICH_TEXT
    assert extract(PLAIN_DIVS, both) == "Head\nText of some length, so that it weighs."
    for page in ("", "   ", "<", "<p", "no markup at all", "<script>x", "<!-- never closed", "</p></div>text", "<p a='1>x</p>"):
        extract(page, levels_of(page))
    assert extract("no markup at all", levels_of("no markup at all")) == "no markup at all"
    long = "<article>" + "<p>word</p>" * 20000 + "<div><div>" * 200
    assert extract(long, levels_of(long)).count("\n") == 19999
    mixed = "<article>" + "".join(f"<{t}>w{k}</{t}>" for k in range(4000) for t in ("p", "h2", "pre", "h3")[:1 + k * k % 4 + k % 3 % 2]) + "</article>"
    assert extract(mixed, levels_of(mixed, mixed.replace("w7", "")))[:9] == "w0\nw1\nw1\n"[:9]
    deep = "<div>x" * 3000
    assert extract(deep, levels_of(deep)).count("x") > 2890      # all that stands in the innermost container
    assert len(json.dumps(page_expression(mixed)[0])) < 2000


def test_names_only_propose():
    """A word of a name does not throw main text away."""
    body = "<p>The first paragraph of the text.</p><p>And the second.</p>"
    text = "The first paragraph of the text.\nAnd the second."
    for wrapped in ("<div class='content-sidebar-wrap'>{}</div>", "<div class='site has-sidebar'>{}</div>", "<div class='post category-cookies'>{}</div>",
                    "<article class='post category-comment'>{}</article>", "<div class='sidebar'><article>{}</article></div>",
                    "<div id='comments'><main>{}</main></div>", "<section id='discussion'>{}</section>", "<div id='related-work'>{}</div>",
                    "<div class='widget'>{}</div>", "<div class='widget'><div class='banner'><article>{}</article></div></div>"):
        page = f"<body><div class='menu'>Home</div>{wrapped.format(body)}<div class='ad-slot'>Buy</div><div class='post-tags'>Spain</div></body>"
        assert extract(page, levels_of(page)) == text, wrapped
    page = "<article><h2 id='social-impact'>Impact</h2><p>x</p><section id='discussion'><h2 id='notice'>Talk</h2><p>y</p></section></article>"
    assert extract(page, levels_of(page)) == "Impact\nx\nTalk\ny"
    # A page of a rare template is not emptied by its host; cards and comments beside an article stay out.
    rare = "<div class='sidebar'><article>" + body + "</article></div>"
    common = "<article><p>" + "A long text. " * 40 + "</p></article><div class='related'><article>Next</article></div><ul class='comments'><li>me too</ul>"
    both = levels_of(*[common] * 5, rare)
    assert extract(rare, both) == text
    assert extract(common, both) == " ".join(["A long text."] * 40)


def test_clean_text_beside_the_main_container_stays():
    half = "<p>A paragraph of some length.</p>" * 3
    pages = {f"<body><h1>T</h1><p>lead</p><div>{half}</div><p>end</p></body>": ["T", "lead", "end"],
             f"<main><h1>Title</h1><article>{half}</article></main>": ["Title"],
             f"<body><article>Short card</article><div>{half}</div></body>": ["Short card"],
             f"<body><div class='entry'>{half}</div><section>More</section></body>": ["More"]}
    every = levels_of(*pages)
    for page, beside in pages.items():
        for rules in (levels_of(page), every):
            lines = extract(page, rules).split("\n")
            assert set(beside) < set(lines) and lines.count("A paragraph of some length.") == 3


def test_expressions():
    a = page_expression("<ul><li>x</li><li>y</li></ul>")[0]
    assert a == [["ul", "1", [["li", "+", [["#", "1", []]]]]]]
    b = page_expression("<ul><li>x</li></ul><hr><p>z</p>")[0]
    assert align(a, b) == [["ul", "1", [["li", "+", [["#", "1", []]]]]], ["p", "?", [["#", "1", []]]]]
    assert align(b, b) == b
    c = page_expression("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd><dt>e</dt><dd>f</dd></dl>")[0]
    text = [["#", "1", []]]
    assert c == [["dl", "1", [["()", "+", [["dt", "1", text], ["dd", "1", text]]]]]]
    assert fold([["p", "1", []], ["p", "?", []]]) == [["p", "*", []]]


def reference_text(page):
    """The pages of the tables have one article of a heading and paragraphs, some of them not closed."""
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", article[1] if article else "")
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_text_of_the_template_goes(spark):
    """What stands in one slot of every page of a host is its template's; what varies, and what is in an article, stays."""
    page = ("<body><div class='strap'>Follow us daily</div><h1>Title {0}</h1><div><p>Text {0}</p><p>Same in the article's place {1}</p></div>"
            "<article><h2>Summary</h2><p>Long text number {0} of this host, with many words of its own in every page.</p></article></body>")
    rows = [(i, "http://a.example/", page.format(i, i % 2)) for i in range(8)] * 2
    rows += [(100 + i, "http://few.example/", page.format(i, 0)) for i in range(4)] + [(200, "http://copies.example/", page.format(0, 0))] * 9
    # Near copies are no template.
    rows += [(300 + i, "http://near.example/", f"<p>{'A long passage. ' * 9}</p><div>{i}</div>") for i in range(9)]
    got = {r.page_id: r.text.split("\n") for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, lines in got.items():
        i, seen = k % 100, "Follow us daily" in lines
        if k >= 300:
            assert lines == [("A long passage. " * 9).strip(), str(i)]
            continue
        assert seen == (k >= 100)
        assert lines[seen:] == [f"Title {i}", f"Text {i}", f"Same in the article's place {i % 2 if k < 100 else 0}", "Summary",
                                f"Long text number {i} of this host, with many words of its own in every page."]


@pytest.mark.parametrize("n", [4, 5, 8, 50])
def test_headings_that_all_pages_share_stay(spark, n):
    """Headings, table heads and labels beside text that varies are main text on hosts of any size; a strap of its own goes."""
    page = ("<body><div>Follow us daily</div><div class='content'><h1>Title {0}</h1><h2>Ingredients</h2><ul><li>Salt</li><li>Flour {0}</li></ul>"
            "<table><tr><th>Name</th><th>Grams</th></tr><tr><td>Sugar</td><td>{0}</td></tr></table><h2>Method</h2><p>Stir <b>well</b> {0} times and let it rest in a warm place until evening comes, then bake it until it is brown all over.</p></div></body>")
    rows = [(i, "http://recipes.example/", page.format(i)) for i in range(n)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: t.removeprefix("Follow us daily\n") for k, t in got.items()} == {
        i: f"Title {i}\nIngredients\nSalt\nFlour {i}\nName\nGrams\nSugar\n{i}\nMethod\nStir well {i} times and let it rest in a warm place until evening comes, then bake it until it is brown all over." for i in range(n)}
    assert all(("Follow us daily" in t) == (n < SEVERAL) for t in got.values())


def test_names_of_pages_do_not_grow_wrappers(spark):
    """Slugs, generated classes and made-up elements leave one expression per host; what a name must tell, it tells."""
    letters = ["".join(chr(97 + i // 26 ** k % 26) for k in range(3)) for i in range(60)]
    rows = [(i, "http://slugs.example/", f"<body><div id='comment{x}' class='css-{x}'><h2 id='my-{x}'>T{i}</h2><my-{x}><p>Body {i}</p></my-{x}></div></body>")
            for i, x in enumerate(letters)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    only = infer_wrappers(df.select(host_of(df.url).alias("host"), "html")).collect()
    assert len(only) == 1 and len(only[0].wrapper) < 300
    assert len({json.dumps(page_expression(r[2])[0]) for r in rows}) == 1
    assert {r.page_id: r.text for r in extract_main_text(df).collect()} == {i: f"T{i}\nBody {i}" for i in range(60)}


def test_registered_query(spark):
    path = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{path}/pages.parquet").collect()
    got = sorted(tuple(r) for r in QUERIES["op8_html"](spark, path).collect())
    assert got == sorted((r.page_id, r.url, reference_text(r.html), len(reference_text(r.html))) for r in pages)


def test_nulls_hosts_and_rounds(spark):
    rows = [(1, "http://A.example/x", RICH, "t", 1), (1, "http://A.example/x", RICH, "t", 1), (2, None, "<p>lone</p>", "t", 1), (3, "http://b", None, "t", 1),
            (None, "nonsense", "<p>also</p>", "t", 1)]
    # Many different expressions on one host, so that they are aligned in rounds.
    for i in range(90):
        rows.append((100 + i, "https://u:p@many.example:80/", "<main>" + "".join(f"<{t}>w{i}</{t}>" for t in ("h2", "p", "pre", "ol", "h3", "dl", "h4")
                                                                             if (i * len(t) + ord(t[-1])) % 3) + "<p>end</p></main>", "t", 1))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {}
    for r in extract_main_text(df).collect():
        got.setdefault(r.page_id, []).append(r)
    assert [r.text for r in got[1]] == [RICH_TEXT] * 2 and got[1][0].n_chars == len(RICH_TEXT)
    assert (got[2][0].text, got[3][0].text, got[3][0].n_chars, got[None][0].text) == ("lone", "", 0, "also")
    assert all(got[100 + i][0].text.endswith("end") for i in range(90))
    pages = df.select(host_of(df.url).alias("host"), df.html).na.fill("", ["html"])
    wrappers = infer_wrappers(pages, group=4).collect()
    assert len(wrappers) == len({r.host for r in wrappers}) == 4
    assert extract_main_text(df.limit(0)).count() == 0

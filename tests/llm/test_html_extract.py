import html
import re

from segmentry.llm import html_extract as H

SITE_A = """<!DOCTYPE html><html><head><title>T{i}</title><style>p{{x}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu {i}</a></li></ul></nav>
<!-- ad <p>no</p> --><div class="ad">Buy {i}</div><article><h1>Head &amp; {i}</h1><p><b>Bold
 text<br><p>Second&nbsp;&eacute; <a href="x">link</a>  end<div class="comments"><p>reader says</p></div><form>Name <input></form></article><aside>side</aside><footer>&copy; foot {i}</footer></body></html>"""
SITE_B = """<html><body><div id="header">Site</div><div class="wrap"><div class="menu"><a href="a">one</a> <a href="b">two</a></div><div class="content"><h2>Title {i}</h2><p>Long paragraph number {i} with a good deal of text in it.</p>
<ul><li>first<li>second</ul>{more}</div></div><div class="cookie-notice">We use cookies</div></body></html>"""


def rows():
    out = [(i, f"http://a.com/{i}", SITE_A.format(i=i)) for i in range(6)]
    out += [(10 + i, f"https://b.com/{i}?x", SITE_B.format(i=i, more="<p>extra</p>" * i)) for i in range(5)]
    out += [(20, "http://one.com/", SITE_A.format(i=20)), (21, None, SITE_B.format(i=21, more="")), (22, "http://a.com/n", None), (23, "http://a.com/e", ""), (24, "http://z.com", "plain  &lt;text"), (25, "http://z.com", "<article><p>open <!-- never closed"), (0, "http://a.com/0", out[0][2])]
    return out


def test_extraction(spark):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.page_id < 6 or r.page_id == 20:
            assert r.text == f"Head & {r.page_id}\n\nBold text\n\nSecond é link end", r.text
        elif r.page_id < 20 or r.page_id == 21:
            more = ["extra"] * (r.page_id - 10) if r.page_id < 20 else []
            assert r.text == "\n\n".join([f"Title {r.page_id % 10 if r.page_id < 20 else 21}", f"Long paragraph number {r.page_id - 10 if r.page_id < 20 else 21} with a good deal of text in it.", "first", "second", *more]), r.text
    by = {r.page_id: r.text for r in got}
    assert by[22] == by[23] == "" and by[24] == "plain <text" and by[25] == "open"
    assert H.extract(df.limit(0)).collect() == []


def test_pages_table(spark):
    from segmentry.llm.queries import op1_main_text

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op1_main_text(spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_heading_and_lead_outside_the_body_stay():
    page = "<html><body><div class=menu><a href=a>one</a></div><div class=wrap><h1>Title</h1><p>Lead</p><div class=body>" + "<p>A long paragraph of the article.</p>" * 20 + "</div></div><div class=footer>foot</div></body></html>"
    assert H.main_text(page, H.own_template(page)).split("\n\n") == ["Title", "Lead"] + ["A long paragraph of the article."] * 20


def judged(spark, pages):
    df = spark.createDataFrame([(i, f"http://x.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return [r.text for r in sorted(H.extract(df).collect(), key=lambda r: r.page_id)]


def story(i, k=6):
    return "".join(f"<p>Paragraph {j} of story {i} tells something that no other page tells, {i * 31 + j} times.</p>" for j in range(k))


def plain(i, k=6):
    return [f"Paragraph {j} of story {i} tells something that no other page tells, {i * 31 + j} times." for j in range(k)]


def test_names_of_the_template_go_and_names_of_few_pages_stay(spark):
    few = '<section id="search-algorithms"><p>On search.</p></section><div class="alert note"><p>Take care.</p></div><math><mi>x</mi></math><noscript><p>Kept</p></noscript>'
    page = lambda i: f"<body><article><h1>T{i}</h1>{story(i)}{few if i == 3 else ''}<div class='related-links'><p>See {i * 7}</p></div><div class=comment-list><p>Reader {i}</p></div></article></body>"
    got = judged(spark, [page(i) for i in range(12)])
    for i, text in enumerate(got):
        assert text.split("\n\n") == [f"T{i}", *plain(i), *(["On search.", "Take care.", "x", "Kept"] if i == 3 else [])]


def test_constant_text_is_template_and_varying_text_is_not(spark):
    page = lambda i: f"<body><div class=top><p>Welcome to the site</p></div><div class=text><h2>T{i}</h2><p>Subscribe to our letter today</p>{story(i)}<p>All rights reserved</p></div></body>"
    assert [t.split("\n\n") for t in judged(spark, [page(i) for i in range(12)])] == [[f"T{i}", *plain(i)] for i in range(12)]
    # copies of one page: all of it is constant, so nothing but the page itself can tell
    copies = judged(spark, [f"<body><div class=text><h2>T</h2>{story(1)}</div></body>"] * 12)
    assert all(t.split("\n\n") == ["T", *plain(1)] for t in copies)


def test_an_article_that_is_a_teaser_is_not_the_root(spark):
    page = lambda i: f"<body><div class=page><article><p>Teaser {i}</p></article><div class=body><h1>T{i}</h1>{story(i)}</div></div></body>"
    assert [t.split("\n\n") for t in judged(spark, [page(i) for i in range(5)])] == [[f"Teaser {i}", f"T{i}", *plain(i)] for i in range(5)]


def test_a_very_long_page_and_other_columns(spark):
    html_page = "<body><article>" + story(1, 20_000) + "</article></body>"
    df = spark.createDataFrame([(1, "http://x.org/", html_page, "a", "b"), (1, "http://x.org/", html_page, "a", "b")], "page_id long, url string, html string, _host string, _template string")
    for r in H.extract(df).collect():
        assert r.text.split("\n\n") == plain(1, 20_000) and r._host == "a" and r._template == "b"

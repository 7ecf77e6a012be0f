import hashlib
import html as H
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import media, pages


@given(st.binary(min_size=1, max_size=2000))
@settings(max_examples=60, deadline=None)
def test_picture_round_trip(data):
    payload = data + bytes([255]) * (-len(data) % media.ROW)
    assert media.png_decode(media.png_encode(payload)) == payload


@pytest.mark.parametrize("kind", range(5))
def test_row_filters_are_undone(kind):
    rng = np.random.default_rng(kind)
    x = rng.integers(0, 256, (5, 12)).astype(int)
    lines = []
    for r in range(5):
        a = np.concatenate(([0], x[r, :-1]))
        b = x[r - 1] if r else np.zeros(12, int)
        c = np.concatenate(([0], b[:-1]))
        p = [min(((abs(bb - cc), 0, aa), (abs(aa - cc), 1, bb), (abs(aa + bb - 2 * cc), 2, cc)))[2] for aa, bb, cc in zip(a, b, c)]
        guess = [0, a, b, (a + b) // 2, np.array(p)][kind]
        lines.append(bytes([kind]) + ((x[r] - guess) & 255).astype(np.uint8).tobytes())

    def chunk(k, d):
        return struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))

    png = media._PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 12, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert media.png_decode(png) == x.astype(np.uint8).tobytes()
    with pytest.raises(ValueError):
        media.png_decode(png[:40] + bytes([png[40] ^ 1]) + png[41:])


def expected(doc_id, text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (576 - len(raw) if not raw else -len(raw) % 576)
    stored = media.png_encode(payload)
    return (doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))


def test_media_query(spark, sf_dir, texts):
    assert sorted(map(tuple, media.op4_media(spark, sf_dir).collect())) == sorted((*expected(d, t), 1, "one sample a byte") for d, t in texts.items())


def test_media_of_odd_rows(odd, none):
    got = sorted((tuple(r)[:8] for r in media.text_media(odd).collect()), key=repr)
    assert got == sorted((expected(r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert media.text_media(none).count() == 0


def test_sequences_stay_aligned(spark):
    a, b = "0a", "0b"
    page = f'<p>One &amp; two<figure><img src="media:{a}" alt="x"><figcaption>First  <b>cap</b></figcaption></figure>three<img src="media:{b}" alt="alt"><img src="media:ff"><script>no</script> four'
    items = media.resolve(
        spark.createDataFrame([(1, page), (2, None), (3, "")], "k long, html string"),
        spark.createDataFrame([(s, d, d.encode()) for d in (a, b) for s in range(4)], "salt int, digest string, stored binary"), ["k"], salts=4,
    )
    got = [(r.position, r.kind, r.text, r.caption, bytes(r.stored) if r.stored else None) for r in items.orderBy("position").collect()]
    assert got == [(0, "text", "One & two", None, None), (1, "media", None, "First cap", b"0a"), (2, "text", "three", None, None), (3, "media", None, "alt", b"0b"), (4, "media", None, None, None), (5, "text", "four", None, None)]
    assert [len(r["items"]) for r in media.assemble(items, ["k"]).collect()] == [6]


def test_unresolved_references_and_copies(spark, monkeypatch):
    a = "0a"
    page = f'<p>One<figure><img src="media:{a}"><figcaption>First</figcaption></figure><img src="media:ff" alt="lost">'
    stored = media.png_encode(b"x" * media.ROW)
    items = media.resolve(spark.createDataFrame([(1, page), (None, page)], "doc_id long, html string"), spark.createDataFrame([(s, a, stored) for s in range(2)], "salt int, digest string, stored binary"), ["doc_id"], salts=2)
    got = {(r.doc_id, r.position): (r.n_bytes, r.media_sha256, r.caption) for r in media.measured(items).collect()}
    found = (media.ROW, hashlib.sha256(stored).hexdigest(), "First")
    assert got == {(d, p): x for d in (1, None) for p, x in ((1, found), (2, (None, None, "lost")))}
    df = spark.createDataFrame([(k % 3, "same " * 50 if k % 4 else f"own {k}") for k in range(400)], "doc_id long, text string")
    rows = media.text_media(df).collect()
    assert len(rows) == 400 and len({(r.payload_sha256, r.media_sha256) for r in rows}) == 101
    assert all(r.payload_bytes == media.ROW and r.position == 1 for r in rows)


def plain(h):
    m = re.search(r"<article>(.*?)</article>", h, re.S)[1]
    return "\n\n".join(x for x in (" ".join(H.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", m)) if x)


def test_pages_query(spark, sf_dir):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in pages.op2_html(spark, sf_dir).collect()}
    assert got == {k: (plain(h), len(plain(h))) for k, h in raw.items()}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a>Home</a></header><div class="cookie-notice">cookies</div><nav>menu</nav>
<article><h1>Title &amp; more</h1><p>First<br>line <b>bold</b><p>Second &nbsp; block<ul><li>x<li>y</ul><aside>side</aside><div class="ad">buy</div><form><p>mail</p></form>
<section id="comments"><article class="comment"><p>I disagree</p></article></section><script>var t="</p>";</script></article><div class="sidebar"><p>more</p></div><footer>end</footer>"""


def test_furniture_goes():
    text = lambda html: pages.main_text(pages.parse(html))[0]
    assert text(PAGE) == "Title & more\n\nFirst line bold\n\nSecond block\n\nx\n\ny"
    assert text(None) == "" and text("plain words") == "plain words"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    # main wins over a teaser; names count whole; a header without a heading is a site's
    assert text("<main><h1>Real</h1><p>The long real story.</p></main><section><article><p>Card teaser text</p></article></section>") == "Real\n\nThe long real story."
    for name in ('class="notice-period"', 'id="search-engine-history"', 'class="comment-on-policy"'):
        assert text(f"<article><p>One</p><div {name}><p>Two</p></div></article>") == "One\n\nTwo"
    for name in ('class="site-notice"', 'id="comments-area"', 'class="ad-slot-2"', 'role="navigation"', 'style="display: none"', "hidden"):
        assert text(f"<article><p>One</p><div {name}><p>Two</p></div></article>") == "One"
    assert text("<main><header>Site tagline</header><p>Text</p></main>") == "Text"
    assert text("<article><header><h1>Title</h1></header><p>Text</p></article>") == "Title\n\nText"
    assert text("<body><div><a>a</a> <a>b</a> <a>c</a></div><p>Text with a <a>link</a> only</p></body>") == "Text with a link only"


def test_templates_of_a_host(spark):
    body = lambda k: f"<body><div><p>Welcome to the site</p></div><div><h2>Story {k}</h2><p>Text number {k} is here.</p></div><div><p>All rights reserved</p></div></body>"
    rows = [(k, f"http://a.example/{k}", body(k)) for k in range(8)] + [(100 + k, "http://b.example/x", body(1)) for k in range(8)] + [(None, None, None), (200, "http://c.example", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "1 AS digest", "'t' AS template", "0 AS n", "'x' AS text")
    got = {(r.page_id, r.url): r.text for r in pages.extract(df).collect()}
    assert got[3, "http://a.example/3"] == "Story 3\n\nText number 3 is here."
    # copies of one page are no template
    assert got[101, "http://b.example/x"].startswith("Welcome to the site") and "Text number 1" in got[101, "http://b.example/x"]
    assert got[None, None] == "" and got[200, "http://c.example"] == ""
    assert pages.extract(df.filter("false")).count() == 0


def test_paragraphs_of_articles_go_only_from_most_pages(spark):
    rows = [
        (k, "http://a.example/", f"<article>{'<p>A common saying of pages.</p>' * (k % 3 == 0)}<p>Own words of page {k} that are here</p><p>Read our rules.</p><div><p>Subscribe now</p></div></article>")
        for k in range(24)
    ]
    got = {r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda k: f"Own words of page {k} that are here"
    assert got == {f"A common saying of pages.\n\n{own(k)}" if k % 3 == 0 else own(k) for k in range(24)}


def site(k, host, named):
    """A page of a host whose furniture is named or not; its menu, notice, form and footer recur, its article doesn't."""
    tag = lambda name, inner: f"<{name}>{inner}</{name.split()[0]}>" if named else f"<div>{inner}</div>"
    return (
        "<html><body>" + tag("header", f"<div>Welcome to {host}</div>") + tag("nav", "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul>") + tag('div class="cookie-notice"', "<p>We use cookies.</p>")
        + tag("article", f"<h1>Story {k} of {host}</h1>" + "".join(f"<p>Paragraph {j} of story {k} of {host}, with some length.</p>" for j in range(4)))
        + tag("aside", "<p>Most read stories</p><ul><li>One</li><li>Two</li></ul>") + tag('section class="comments"', f"<p>{host} readers say hello</p>") + tag("footer", f"<p>&copy; {host}</p>") + "</body></html>"
    )


@pytest.mark.parametrize("most", [0, 1000])
def test_templates_alone_give_the_text_that_names_give(spark, most):
    """The method by itself: the same pages without any name of furniture give the same texts."""
    want = {(h, k): "\n\n".join([f"Story {k} of {h}", *[f"Paragraph {j} of story {k} of {h}, with some length." for j in range(4)]]) for h in ("a.example", "b.example") for k in range(12)}
    for named in (True, False):
        rows = [(k, f"http://{h}/{k}", site(k, h, named)) for h, k in want]
        got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), most=most).collect()
        assert {(r.url.split("/")[2], r.page_id): r.text for r in got} == want
        assert all(r.n_template >= 5 for r in got)


def test_an_article_in_copies_is_no_template(spark):
    rows = [(k, "http://a.example/", site(1, "a.example", False)) for k in range(50)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Story 1" in r.text and r.n_template == 0 for r in got)


def test_broken_and_very_long_pages(spark):
    long = "<article>" + "<p>word <b>bold</p" * 3 + "".join(f"<p>paragraph {k}" for k in range(20_000)) + "</table></ul>"
    rows = [(1, "http://a.example/", long), (2, "http://a.example/", "</p></div><<p>x &amp &#x41;&bogus; <"), (2, None, "<![CDATA[x]]><?php a ?><p>y")]
    got = {(r.page_id, r.url): r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1, "http://a.example/"].endswith("paragraph 19998\n\nparagraph 19999")
    assert "x & A" in got[2, "http://a.example/"] and got[2, None].endswith("y")


def extracted(spark, htmls, url="http://a.example/"):
    rows = [(k, f"{url}{k}", h) for k, h in enumerate(htmls)]
    return [r.text for r in sorted(pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_what_recurs_in_articles_stays(spark, tag):
    """Section headings, lists, tables and quotations that many or all articles of a host hold."""
    menu = "<ul><li><a href=1>One page</a></li><li><a href=2>Another page</a></li></ul>"
    recipe = lambda k: f"<body>{menu}<{tag}><h1>Dish {k}</h1><p>The story of dish number {k}, which is told at some length here.</p><h2>Ingredients</h2><ul><li>Salt</li><li>Water</li></ul><h2>Method</h2><p>Cook dish {k} as you like it best.</p><table><tr><td>Serves</td><td>4</td></tr></table></{tag}></body>"
    want = [f"Dish {k}\n\nThe story of dish number {k}, which is told at some length here.\n\nIngredients\n\nSalt\n\nWater\n\nMethod\n\nCook dish {k} as you like it best.\n\nServes\n\n4" for k in range(8)]
    assert extracted(spark, [recipe(k) for k in range(8)]) == want
    quote = "<blockquote><p>What we know is little, and what we do not know is immense.</p></blockquote>"
    essay = lambda k: f"<{tag}><p>Essay number {k} begins with these words of its own.</p>{quote if k % 7 == 0 else ''}<p>And essay {k} ends with others.</p></{tag}>"
    got = extracted(spark, [essay(k) for k in range(40)])
    assert all(("What we know is little" in x) == (k % 7 == 0) and f"essay {k} ends" in x for k, x in enumerate(got))


def test_links_and_fields_that_recur_in_articles_go(spark):
    box = "<div><p>Read <a href=1>the first of our stories</a></p><p><a href=2>and a second one</a></p></div><div>Your mail: <input name=m></div>"
    got = extracted(spark, [f"<article><h1>Story {k}</h1><p>Text of story {k} in its own words.</p>{box}</article>" for k in range(8)])
    assert got == [f"Story {k}\n\nText of story {k} in its own words." for k in range(8)]


STORY = "<h1>The title</h1>" + "".join(f"<p>Paragraph {k} of a story that is long enough to be told from furniture by its text.</p>" for k in range(4))
TOLD = "The title\n\n" + "\n\n".join(f"Paragraph {k} of a story that is long enough to be told from furniture by its text." for k in range(4))


def test_wrappers_of_a_page_are_no_furniture():
    text = lambda html: pages.main_text(pages.parse(html))[0]
    for html in (
        f'<body><form id="aspnetForm" action="/"><input type=hidden><article>{STORY}</article><footer>end</footer></form></body>', f'<form><div>{STORY}</div><nav><a>menu</a></nav></form>',
        f'<body><div class="widget Blog"><div class="post">{STORY}</div></div><div class="sidebar">side</div></body>', f'<main><div id="search">{STORY}</div></main>', f'<div class="page-overlay"><div role="dialog">{STORY}</div></div>',
    ):
        assert text(html) == TOLD
    # comments aren't a wrapper, however long, and a short form isn't an article
    assert text(f'<article><h1>Short</h1><p>One line.</p><div class="comment-list">{STORY}</div></article>') == "Short\n\nOne line."
    assert text("<body><p>Hello</p><form><p>Log in here</p><input></form></body>") == "Hello"


@pytest.mark.parametrize("name", ["commentlist", "comment-body", "post-comments-v3", "adsbygoogle", "newsletter-cta", "share-this-story", "related-reading", "taboola", "outbrain-widget", "advert-zone"])
def test_further_names_of_furniture(name):
    assert pages.main_text(pages.parse(f'<article>{STORY}<div class="{name}"><p>Something else that is no part of it</p></div></article>'))[0] == TOLD


@pytest.mark.parametrize("name", ["story-body", "reading", "commentary", "article-body", "adventure", "this-story"])
def test_names_of_articles(name):
    got = pages.main_text(pages.parse(f'<body><p>Before it.</p><div class="{name}">{STORY}</div></body>'))[0]
    assert got == f"Before it.\n\n{TOLD}"

import html as entities
import re
import time

import pytest

from tessera.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy this</div>
<article><header><h1>Title &amp; more</h1></header><p><b>First   line<br>goes on.<p>Short.</p>
<ul><li>one<li>two</ul><form><input name=q><label>Your mail</label></form><p>Caf&eacute;&nbsp;&#8212; x&lt;y</p><aside>Also read</aside></article>
<section id="comments"><p>I like this article very much, it is long and full of words.</p></section>
<footer>&copy; us</footer>"""


def test_article():
    assert h.blocks(PAGE) == ["Title & more", "First line goes on.", "Short.", "one", "two", "Café — x<y"]


def test_without_an_article_element():
    body = "".join(f"<p>{'A sentence of some length that tells the story. ' * 4}{i}</p>" for i in range(5))
    page = f"<html><body><div id=menu><a href=1>Home</a> <a href=2>News</a></div><div><h2>Head</h2>{body}</div><div class=footer><a>Imprint</a></div></body></html>"
    got = h.blocks(page)
    assert got[0] == "Head" and len(got) == 6 and "Imprint" not in got


def _paragraphs(n, of="p"):
    return "".join(f"<{of}>{'A sentence of some length that tells the story. ' * 4}{i}</{of}>" for i in range(n))


@pytest.mark.parametrize(
    ("body", "lines"),
    [
        (f"<div><h2>Head</h2>{_paragraphs(7)}</div><div>{_paragraphs(3)}</div>", 11),
        (f"<div><div>{_paragraphs(7)}</div><div><div>{_paragraphs(2)}</div><div>{_paragraphs(2)}</div></div></div>", 11),
        (f"<div><h1>Head</h1><p>{'Before the quotation. ' * 9}</p><blockquote>{_paragraphs(6)}</blockquote>{_paragraphs(2)}</div>", 10),
        (f"<div><h1>Head</h1><ul>{_paragraphs(6, 'li')}</ul>{_paragraphs(2)}</div>", 9),
        (f"<div><h1>Head</h1><blockquote>{_paragraphs(3)}</blockquote></div>", 4),
    ],
)
def test_all_parts_of_an_article_in_plain_containers(body, lines):
    page = f"<html><body><div id=menu><a href=1>Home</a> <a href=2>News</a></div><div>{body}</div><div class=footer><a>Imprint</a></div></body></html>"
    got = h.blocks(page)
    assert len(got) == lines and "Imprint" not in got and ("Head" in got) == ("Head" in body)


@pytest.mark.parametrize("name", ["layout with-sidebar", "has-sidebar", "no-sidebar", "page header-fixed", "comments-open post", "elementor-widget", "sidebar", "widget"])
@pytest.mark.parametrize("of", ["article", "main", "div"])
def test_wrappers_named_after_a_layout(name, of):
    beside = "<div class=sidebar><p>Beside the text.</p></div><div class='site-footer'>Imprint</div><div class='cookie-notice'>Cookies</div>"
    page = f'<html><body><div class="{name}"><{of}><div class="entry-header"><h1>Head</h1></div>{_paragraphs(3)}</{of}>{beside}</div></body></html>'
    got = h.blocks(page)
    assert len(got) == 4 and got[0] == "Head"


@pytest.mark.parametrize("name", ["entry-header", "article-header", "header"])
def test_headers_of_an_article(name):
    assert h.blocks(f'<article><div class="{name}"><h1>Head</h1></div><p>The text of it.</p></article>') == ["Head", "The text of it."]


@pytest.mark.parametrize("name", ["comments", "comment-list", "related-posts"])
def test_a_thread_may_be_longer_than_its_article(name):
    thread = f"<article>{_paragraphs(9)}</article>"
    assert h.blocks(f"<body><div><h1>Head</h1>{_paragraphs(3)}</div><div id={name}>{thread}</div></body>")[0] == "Head"
    assert len(h.blocks(f"<body><div><h1>Head</h1>{_paragraphs(3)}</div><div id={name}>{thread}</div></body>")) == 4


@pytest.mark.parametrize("page", [None, "", " ", "<html>", "<p>", "<script>x", "<!-- only", "<nav>menu</nav>"])
def test_pages_without_text(page):
    assert h.extract_text(page) == ""


@pytest.mark.parametrize(
    "before",
    [
        '<script>if(a.indexOf("<!--")<0){}</script>', "<style><!-- p{} </style>", '<img title="<!--">', "<!-- x --!>", "<!-->", "<!--->", "<!-- a --><!-- b -->",
    ],
)
def test_comment_marks_cut_nothing(before):
    page = f"<html><body>{before}<article><h1>Head</h1><p>The text of it.</p></article></body></html>"
    assert h.blocks(page) == ["Head", "The text of it."]
    assert h.blocks(page.replace("</article>", "<!-- never closed <p>gone</p></article>")) == ["Head", "The text of it."]


def test_ratios_are_smoothed_by_a_gaussian():
    assert h.smooth([3.0, 3.0, 3.0]) == pytest.approx([3.0] * 3)
    out = h.smooth([0.0, 0.0, 9.0, 0.0, 0.0])
    assert out[2] == max(out) and out[1] == pytest.approx(out[3]) and out[0] < out[1]
    assert h.smooth([]) == []


def test_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = h.op4_html_extraction(spark, sf).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    for r in rows:
        assert "track(" not in r.text and "©" not in r.text
    odd = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", PAGE, "x"), (2, "u", "<p>" * 3000 + "deep text here" + "<div>" * 3000, "x")], "page_id long, url string, html string, text string")
    got = h.extract(odd).collect()
    assert [r.n_chars > 0 for r in sorted(got, key=lambda r: (r.page_id is None, r.page_id or 0, r.n_chars))] == [False, False, True, True]
    assert h.extract(odd.limit(0)).collect() == []


def direct_reading(page):
    """The article element of a generated page, read by patterns."""
    body = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|li|div|blockquote)\b[^>]*>", body)
    texts = [entities.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", re.sub("<!--.*?-->", "", x, flags=re.S))) for x in parts]
    return "\n\n".join(" ".join(x.split()) for x in texts if x.split())


def test_all_pages_equal_a_direct_reading(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in h.op4_html_extraction(spark, sf).collect():
        assert r.text == direct_reading(pages[r.page_id]), r.page_id


def test_pages_without_article_elements(spark):
    """The generated pages with the article in a plain container, and plain lists of links
    around it that no tag and no name marks: the ratios tell them apart."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    links = "<div>" + "".join(f"<div><a href=/{i}>{w}</a></div>" for i, w in enumerate("News Sport World Money More Video Shop Help".split())) + "</div>"
    advert, imprint = "<div><p>buy our stuff now</p></div>", "<div>Copyright 2024</div>"
    same = plain = changed = beside = 0
    for page in pages:
        want = direct_reading(page)
        if len(want) < 1000:
            continue
        plain += 1
        beside += h.extract_text(page.replace("<article>", f"{links}{advert}<div class=x>").replace("</article>", f"</div>{advert}{imprint}")) == want
        page = page.replace("<article>", f"{links}<div class=x>").replace("</article>", f"</div>{links}")
        same += h.extract_text(page) == want
        h_ratios, h.ratios = h.ratios, lambda lines, sigma=1.0: [1.0] * len(lines)
        try:
            changed += h.extract_text(page) != want
        finally:
            h.ratios = h_ratios
    assert plain > 100 and same >= 0.99 * plain and changed == plain and beside >= 0.99 * plain, (plain, same, changed, beside)


def test_decoy_names_do_not_decide():
    story, promo = _paragraphs(6), "<div><p>buy our stuff now</p></div>"
    for name in ("post-tags-x", "share", "alert", "with-sidebar", "ad-free"):
        got = h.blocks(f'<body><div class="{name}"><h1>Head</h1>{story}</div>{promo}</body>')
        assert got == ["Head", *h.blocks(f"<article>{story}</article>")], name
    for name in ("alert", "share", "tags", "note search"):
        assert h.blocks(f'<article><p>The text.</p><p class="{name}">An important paragraph.</p></article>') == ["The text.", "An important paragraph."]
    assert h.blocks('<article><p>The text.</p><div class="ad">Buy</div><p class="ad-slot">Buy</p><div class="cookie-notice"><p>Cookies</p></div></article>') == ["The text."]
    assert h.blocks("<article><p>Let <math><mi>x</mi></math> be.</p></article>") == ["Let x be."]


def test_what_stands_beside_a_text_in_plain_containers():
    """Adverts, menus and imprints without a name or a tag that tells."""
    story = _paragraphs(6)
    want = ["Head", *h.blocks(f"<article>{story}</article>")]
    body = f"<div><h1>Head</h1>{story}</div>"
    menu, advert, imprint = "<div><a>Home</a><a>News</a></div>", "<div><p>buy our stuff now</p></div>", "<div>Copyright 2024</div>"
    for page in (f"{menu}{body}", f"{body}{advert}", f"{body}{imprint}", f"{menu}{advert}{body}{advert}{imprint}", f"<div>{menu}</div><div>{body}</div><div>{imprint}</div>"):
        assert h.blocks(f"<html><body>{page}</body></html>") == want, page[:60]
    # a heading in a container of its own, and short lines inside the text, belong to it
    assert h.blocks(f"<body>{menu}<div><h1>Head</h1></div><div>{story}</div>{imprint}</body>") == want
    assert h.blocks(f"<body><div><h1>Head</h1>{_paragraphs(3)}<div><p>Short.</p></div>{_paragraphs(3)}</div>{advert}</body>")[4] == "Short."
    assert h.blocks(f"<body>{menu}<div><p>A short note.</p></div></body>")[-1] == "A short note."


def test_a_discussion_inside_an_article():
    paper = f"<article><h1>Paper</h1>{_paragraphs(3)}<div class='discussion'><h2>Discussion</h2><p>What it means.</p></div></article>"
    assert h.blocks(paper)[-2:] == ["Discussion", "What it means."]
    assert h.blocks("<article><p>The text.</p></article><div class='discussion'><p>I like it.</p></div>") == ["The text."]
    assert h.blocks("<article><p>The text.</p><div class='comments'><p>I like it.</p></div></article>") == ["The text."]


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<div>" * 50_000 + "x" + "</span>" * 50_000, "<b>" + "<div>x" * 25_000 + "</b>" * 25_000, "<span>" * 25_000 + "<div>x</div>" * 25_000])
def test_time_is_linear_in_nesting(page):
    began = time.perf_counter()
    assert h.extract_text(page).count("x") == page.count("x")
    assert time.perf_counter() - began < 10


def test_pipeline(spark, odd_docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] > seen[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf).count() == len(out)
    # odd rows and no rows pass every stage
    for start in (odd_docs, odd_docs.limit(0)):
        frame = start
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf)
            frame = spark.createDataFrame(frame.collect(), frame.schema)

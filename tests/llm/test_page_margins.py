"""What a template may cut of an article, names inside articles, and pages made to take long."""

import random
import time

import pytest

from evigraph.llm.html_text import Element, blocks, extract, main_text, parse, text_token

ROW = "page_id long, url string, html string"


def texts_of(spark, pages):
    rows = [(i, f"http://news.example/{i}", h) for i, h in enumerate(pages)]
    return [r["text"] for r in sorted(main_text(spark.createDataFrame(rows, ROW)).collect(), key=lambda r: r["page_id"])]


def page(article, before="<nav>menu</nav>", after="<footer>foot</footer>"):
    return f"<html><body>{before}<article>{article}</article>{after}</body></html>"


def test_fixed_headings_stay(spark):
    body = lambda i: "".join(f"<h2>{h}</h2><p>{h} of study {i}, told at length.</p>" for h in ("Introduction", "Methods", "Results"))
    for i, text in enumerate(texts_of(spark, [page(body(i)) for i in range(12)])):
        assert text.split("\n\n") == [x for h in ("Introduction", "Methods", "Results") for x in (h, f"{h} of study {i}, told at length.")]


def test_fixed_margins_go_and_fixed_inner_texts_stay(spark):
    article = lambda i: f"<p>Brought to you by a friend</p><h3>Letter</h3><div>Get our letter</div><h1>Title {i}</h1><p>One {i}</p><p>Said on all pages</p><p>Two {i}</p><h3>More</h3><div>Read more of us</div>"
    for i, text in enumerate(texts_of(spark, [page(article(i)) for i in range(8)])):
        assert text.split("\n\n") == [f"Title {i}", f"One {i}", "Said on all pages", f"Two {i}"]


def test_a_section_that_some_pages_share_stays(spark):
    shared = "<p>A passage that these have in common.</p><p>It has a second paragraph.</p><p>And a third one.</p>"
    article = lambda i: f"<h1>Title {i}</h1><p>Own words {i}</p>{shared if i % 4 == 0 else ''}<p>End {i}</p>{shared.replace('passage', 'end') if i % 5 == 0 else ''}"
    for i, text in enumerate(texts_of(spark, [page(article(i)) for i in range(20)])):
        assert text.count("A passage") == (i % 4 == 0) and text.count("A end") == (i % 5 == 0) and f"End {i}" in text and "foot" not in text


@pytest.mark.parametrize("attribute", ['class="navy"', 'class="commentary"', 'class="banner"', 'class="navigation"', 'class="promotion"', 'id="shareholders"', 'id="login"', 'class="commented"', 'class="related-work"', 'class="side"'])
def test_names_that_articles_may_have(attribute):
    assert extract(page(f"<p>a</p><div {attribute}>kept</div><p>b</p>")) == "a\n\nkept\n\nb"


@pytest.mark.parametrize("attribute", ['class="ad"', 'class="comments"', 'class="nav"', 'class="share social"', 'id="newsletter"', 'class="cookie-notice"', 'class="x pagination"', 'role="navigation"'])
def test_names_that_set_apart(attribute):
    assert extract(page(f"<p>a</p><div {attribute}>gone</div><p>b</p>")) == "a\n\nb"


def test_blocks_against_a_plain_model():
    """Only what stands before the first text of the page's own, and behind the last, is cut."""
    rng = random.Random(1)
    for _ in range(300):
        parts = [(rng.choice(["h2", "p", "div"]), rng.choice(["fixed one", "fixed two", f"own {rng.random()}"])) for _ in range(rng.randrange(0, 9))]
        root = parse("<main>" + "".join(f"<{t}> {x}\n</{t}>" for t, x in parts) + "</main>")
        main = next(k for k in root.kids if isinstance(k, Element))
        template = frozenset(text_token(k.path, text.strip()) for k in main.kids for text in k.kids if text.strip().startswith("fixed"))
        own = [i for i, (_, x) in enumerate(parts) if x.startswith("own")]
        want = []
        if own:
            first = own[0]
            while first and parts[first - 1][0] == "h2":
                first -= 1
            want = [x for _, x in parts[first : own[-1] + 1]]
        assert blocks(main, template) == (want if template else [x for _, x in parts])


HOSTILE = ["<a ", "<div></b>", "<span><p></p>", '<a ">" ', "<a '\"", "<article>", "<a<", "<!--", "<script>", "<p class=\"", "<article><p>x", "<table><tr><td>x</td>", '<div class="nav_x">', "&", "<b", "</", "<option><tr><dt>", "<main><div class='ad-x'>"]


@pytest.mark.parametrize("bit", HOSTILE)
def test_pages_made_to_take_long(bit):
    """A megabyte of any of these, by itself and between many open elements, is read in seconds."""
    many = (1 << 20) // len(bit)
    for text in (bit * many, "<div>" * (many // 2) + bit * (many // 2), bit * many + '">' + "<p>end"):
        began = time.perf_counter()
        extract(text)
        assert time.perf_counter() - began < 25


def test_names_made_to_take_long():
    began = time.perf_counter()
    extract(f"<div class=\"{'nav_' * 200_000}!\" id='{'ad-' * 200_000}x'>text</div>")
    assert time.perf_counter() - began < 5

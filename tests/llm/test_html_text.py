import time

import pytest

from reviewloom.llm.html_text import extract_text, main_blocks

LONG = "This sentence belongs to the article and is long enough to look like prose. " * 3


def page(body, head="<title>T</title><style>p{margin:0}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "article among menus": (
        page(f"<nav><ul><li><a href=/>Home</a></ul></nav><header>Site</header><article><h1>Head &amp; line</h1><p>{LONG}<p>Short.<br>Two</article><footer>&copy; x</footer>"),
        ["Head & line", LONG.strip(), "Short. Two"],
    ),
    "comments, forms and adverts inside": (
        page(
            f"<main><article><header><h1>H</h1></header><p>a{LONG}</p><div class='ad-slot'>Buy</div><form>Mail <input></form><aside>Side</aside><p>z</p>"
            f"<section id=comments><article class=comment><p>{LONG * 9}</p></article></section></article></main><div class=cookie-notice>OK?</div>"
        ),
        ["H", ("a" + LONG).strip(), "z"],
    ),
    "no article element": (
        page(f"<div id=page><div class=menu><a href=1>one</a> <a href=2>two</a></div><div class=text><h2>Head</h2><p>{LONG}</p><ul><li>x<li>y</ul><p>{LONG}</p></div><div class='sidebar'>s</div></div>"),
        ["Head", LONG.strip(), "x", "y", LONG.strip()],
    ),
    "mark on the wrapper": (page(f"<div class='has-sidebar'><h1>H</h1><p>{LONG}</p><div class=sidebar>no</div></div>"), ["H", LONG.strip()]),
    "white space and references": (page("<article><p>a&nbsp;\u2003b&#x63;\n\t<b>d</b>e &lt;p&gt;</p></article>"), ["a b c de <p>".replace(" c", "c")]),
    "broken": ("<article><p><b>one<p>two</i></div>three<ul><li>four<table><tr><td>five", ["one", "twothree", "four", "five"]),
    "only an advert": ("<div class=ad>Buy now</div><article><h1></h1></article>", []),
    "script with tags": (page("<script>var t='<p>no</p>';</script><article><p>yes</p><!-- <p>no</p> --></article>"), ["yes"]),
    "no markup": ("plain  text", ["plain text"]),
}


@pytest.mark.parametrize("name", CASES)
def test_blocks(name):
    html, want = CASES[name]
    got = main_blocks(html)
    assert got == want


def test_rows(spark):
    rows = [(1, "u", CASES["article among menus"][0], 5), (2, None, None, 6), (None, "v", "", 7), (4, "w", "<p></p>", 8), (4, "w", "<p>\U0001d400é</p>", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(2)
    got = sorted(map(tuple, extract_text(df).collect()), key=repr)
    first = "\n\n".join(CASES["article among menus"][1])
    assert got == sorted([(1, "u", first, len(first)), (2, None, "", 0), (None, "v", "", 0), (4, "w", "", 0), (4, "w", "\U0001d400é", 2)], key=repr)
    assert extract_text(df.where("false")).collect() == []


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<div>" * n + "x",
        lambda n: "<p><table><td>" + "<div>" * n + "x",
        lambda n: "<ul>" + "<div>" * n + "<li>x" * n,
        lambda n: "<b><p>" * n + "x</b>" * n,
        lambda n: "<p>x" * n,
        lambda n: "<table><tr><td>" * n + "x",
    ],
)
def test_time_is_linear(make):
    def took(n):
        start = time.perf_counter()
        main_blocks(make(n))
        return time.perf_counter() - start

    assert min(took(16000) for _ in range(2)) < 12 * min(took(2000) for _ in range(2)) + 0.2


WHOLE = {
    "title, intro and list beside the body": (
        page(f"<div class=post><h1>Title</h1><p>Intro</p><div class=body><p>{LONG}</p><p>{LONG}</p></div><ul><li>x<li>y</ul></div>"),
        ["Title", "Intro", LONG.strip(), LONG.strip(), "x", "y"],
    ),
    "intro and table beside the body, no heading": (
        page(f"<div><p>Intro</p><div class=body><p>{LONG}</p><p>{LONG}</p></div><table><tr><td>1<td>2</table></div>"),
        ["Intro", LONG.strip(), LONG.strip(), "1", "2"],
    ),
    "two sections": (page(f"<section><p>{LONG * 6}</p></section><section><p>{LONG}</p></section>"), [(LONG * 6).strip(), LONG.strip()]),
    "heading and intro beside the article in main": (
        page(f"<div><a href=/>Home</a></div><main><h1>H</h1><p>Intro</p><article><p>{LONG}</p><p>{LONG}</p></article></main>"),
        ["H", "Intro", LONG.strip(), LONG.strip()],
    ),
    "two articles in main": (page(f"<main><article><p>{LONG * 3}</p></article><article><p>Short</p></article></main>"), [(LONG * 3).strip(), "Short"]),
    "heading, intro and list beside the article": (
        page(f"<ul><li><a href=/a>A</a><li><a href=/b>B</a></ul><h1><a href=/t>Title</a></h1><p>Intro, <a href=/c>c</a></p><article><p>{LONG}</p><p>{LONG}</p></article><ul><li>x</ul>"),
        ["Title", "Intro, c", LONG.strip(), LONG.strip(), "x"],
    ),
}


@pytest.mark.parametrize("name", WHOLE)
def test_nothing_unmarked_is_lost(name):
    html, want = WHOLE[name]
    assert main_blocks(html) == want


MARKED = {
    "the article in a widget": page(f"<main><h1>H</h1><div class='elementor-widget elementor-widget-text-editor'><p>{LONG}</p></div></main>"),
    "the article in a plain widget": page(f"<main><h1>H</h1><div class=widget><p>{LONG}</p></div><div class=ad>Buy</div></main>"),
    "marks inside longer names": page(f"<article><h1>H</h1><div class='with-sidebar'><div id=social-science><p>{LONG}</p></div></div></article>"),
    "state of the comments": page(f"<h1>H</h1><div class='post comments-open'><p>{LONG}</p></div><div id=comments><p>{LONG * 9}</p></div>"),
    "a notice of minor size": page(f"<main><h1>H</h1><p>{LONG}</p><div class='cookie-notice'><p>We use cookies.</p></div></main>"),
    "a heading among the readers": page(f"<div class=comments><h1>H</h1><p>{LONG}</p></div>"),
}


@pytest.mark.parametrize("name", MARKED)
def test_marks_take_no_article(name):
    assert main_blocks(MARKED[name]) == ["H", LONG.strip()]


def test_marked_parts_that_hold_much_of_the_text():
    parts = "".join(f"<div class='widget'><p>{i}{LONG}</p></div>" for i in range(3))
    assert main_blocks(page(f"<main><h1>H</h1>{parts}<div class=share><a href=1>a</a> <a href=2>b</a></div></main>")) == ["H"] + [f"{i}{LONG}".strip() for i in range(3)]


SHORT = "One sentence here."
PARTS = "sidebar advert newsletter cookie-notice footer disqus_thread comment-thread user-comments reader-comments related-posts related-articles header site-header footer-text cookie-policy cookies-eu-banner adsbygoogle google-ads ad-unit advert-300x250".split()


@pytest.mark.parametrize("text", [SHORT, LONG.strip() * 4])
@pytest.mark.parametrize("name", PARTS)
def test_marked_parts_go_beside_and_inside(name, text):
    part = f"<div class='{name}'><p>{LONG * 3}</p><p>{LONG}</p></div>"
    for html in (
        f"<article><h1>H</h1><p>{text}</p></article>{part}", f"{part}<article><h1>H</h1><p>{text}</p>{part}</article>",
        f"{part}<div><h1>H</h1><p>{text}</p></div>{part}", f"<main><h1>H</h1><p>{text}</p>{part}</main>",
    ):
        assert main_blocks(page(html)) == ["H", text], html


INSIDE = {
    "a form around the page": f"<form><h1>H</h1><p>{LONG}</p><p>{SHORT}</p></form>",
    "a form around the page, no heading": f"<form><div><p>{LONG}</p><p>{SHORT}</p></div></form>",
    "a menu that is not closed": f"<nav><ul><li><a href=/>Home</a></ul><article><h1>H</h1><p>{LONG}</p><p>{SHORT}</p></article>",
    "a hidden body": f"<div aria-hidden=true><article><h1>H</h1><p>{LONG}</p><p>{SHORT}</p></article></div>",
    "an unseen body": f"<div style='visibility: hidden'><main><h1>H</h1><p>{LONG}</p><p>{SHORT}</p></main></div>",
    "the title in a header": f"<header><h1>H</h1></header><article><p>{LONG}</p><p>{SHORT}</p></article>",
    "the title in a header, no article": f"<header><nav><a href=/>Home</a></nav><h1>H</h1></header><div><p>{LONG}</p><p>{SHORT}</p></div>",
    "links and a skip link": f"<a href=#c>Skip</a><div><a href=/a>A</a> <a href=/b>B</a></div><h1>H</h1><p>{LONG}</p><p>{SHORT}</p><div><a href=/c>C</a></div>",
    "a comment without an end": f"<article><h1>H</h1><p>{LONG}</p><p>{SHORT}</p></article><!-- <p>no</p>",
    "a long sidebar beside a short page": f"<h1>H</h1><p>{LONG}</p><p>{SHORT}</p><aside><p>{LONG * 9}</p></aside>",
    "a header of the site beside the title": f"<header><h1>Site</h1></header><article><h1>H</h1><p>{LONG}</p><p>{SHORT}</p></article>",
}


@pytest.mark.parametrize("name", INSIDE)
def test_no_page_is_lost_in_its_frame(name):
    want = ["H", LONG.strip(), SHORT]
    assert main_blocks(page(INSIDE[name])) == (want[1:] if "no heading" in name else want)


def test_links_inside_the_region_stay():
    html = f"<div><h1>H</h1><p>{LONG}</p><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul><p>{LONG}</p></div><div><a href=/c>C</a></div>"
    assert main_blocks(page(html)) == ["H", LONG.strip(), "A", "B", LONG.strip()]


def test_generated_pages_against_their_own_text():
    """Pages put together from known blocks: what was put into the article comes out, nothing else."""
    import random
    from html import escape

    r = random.Random(4)
    marks = PARTS + ["menu", "share", "newsletter-signup", "promo-box"]
    for n in range(300):
        blocks = ["".join(r.choice("ab é<&水") for _ in range(r.randrange(1, 200))).strip() or "x" for _ in range(r.randrange(1, 8))]
        blocks = [" ".join(b.split()) or "x" for b in blocks]

        def junk():
            kind, name = r.randrange(4), r.choice(marks)
            text = f"<p>{LONG * r.randrange(3)}junk</p>"
            return [f"<nav>{text}</nav>", f"<div class='{name}'>{text}</div>", f"<aside>{text}</aside>", f"<script>{text}</script>"][kind]

        body = "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "<ul><li>{}</ul>"]).format(escape(b)) + (junk() if r.random() < 0.3 else "") for b in blocks)
        frame = r.choice(["<article>{}</article>", "<main>{}</main>", "<div id=page><article>{}</article></div>"])
        assert main_blocks(page(junk() + frame.format("<p>first</p>" + body) + junk())) == ["first", *blocks]

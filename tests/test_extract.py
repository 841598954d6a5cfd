import time

import pytest

from reviewloom.operators.extract import PLACE_PICKS, picked_links, place_pages
from reviewloom.operators.html_pick import All, Css, First, _Page, pick_elements

LISTING = """<div role="feed"><a class="x hfpxzc" aria-label="Pantai &amp; Co" href="https://m/1"></a>
<a class="hfpxzc" aria-label="" href="https://m/2"></a><a class="hfpxzc" aria-label="No link"></a>
<a class="other" aria-label="Other" href="https://m/3"></a><a class=hfpxzc aria-label=Dua href=https://m/4>x</a></div>"""


def card(text="bagus", user="Ann<br>Local guide", stars=4, time="2 hari lalu", inner=""):
    parts = ['<div class="jftiEf" data-review-id="r">']
    if user is not None:
        parts.append(f'<div class="d4r55 fontTitleMedium">{user}</div>')
    if stars is not None:
        filled = '<span class="hCCjke x"></span>' * stars
        parts.append(f'<div class="DU9Pgb"><span>{filled}</span><span class="empty"></span></div>')
    if time is not None:
        parts.append(f'<span class="rsqaWe">{time}</span>')
    if text is not None:
        parts.append(f'<span class="wiI7pd">{text}</span>')
    return "".join(parts) + inner + "</div>"


def place(cards="", about=True, reviews=True, name='<h1 class="DUwDvf lfPIob">Page name</h1>'):
    return f"""<html><body>{name}
<div class="fontBodyMedium dmRWX"><span><span aria-hidden="true">4,6</span></span>
  <span><span aria-label="1.234 ulasan">(1.234)</span></span></div>
<button class="DkEaL ">Pantai</button>
{'<div class="Gpq6kf NlVald">Tentang</div>' if about else ''}
{'<div class="Gpq6kf NlVald">Ulasan</div>' if reviews else ''}
<div class="Io6YTe fontBodyMedium kR99db fdkmkc">Jl. Satu</div>
<div class="Io6YTe fontBodyMedium kR99db fdkmkc">0812</div>
<span class="HlvSq">Pasir putih.</span>
<ul class="ZQ6we"><li class="hpLkke"><span>Parkir<br>Gratis</span></li><li class="hpLkke">WC</li><li>x</li></ul>
{cards}</body></html>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(f"https://m/{i}", h) for i, h in enumerate(htmls)], "url string, html string")


def one(spark, html, **kw):
    return place_pages(pages(spark, html), **kw).first()


def test_listing(spark):
    got = [(r.pos, r.place_name, r.gmaps_url) for r in picked_links(pages(spark, LISTING)).collect()]
    assert got == [(0, "Pantai & Co", "https://m/1"), (3, "Dua", "https://m/4")]


def test_place_info(spark):
    info = one(spark, place()).place_info.asDict()
    assert info == {
        "name": "Page name",
        "category": "Pantai",
        "avg_rating": "4.6",
        "total_reviews_text": "1.234 ulasan",
        "address": "Jl. Satu",
        "description": "Pasir putih.",
        "attributes": "Parkir: Gratis | WC",
    }


def test_defaults_and_tabs(spark):
    bare = one(spark, "<h1>Only</h1>" + card())
    assert bare.place_info.asDict() == {
        "name": "", "category": "", "avg_rating": "0", "total_reviews_text": "", "address": "", "description": "",
        "attributes": "",
    }
    assert bare.reviews == []
    no_about = one(spark, place(card(), about=False))
    assert (no_about.place_info.description, no_about.place_info.attributes) == ("", "")
    assert len(no_about.reviews) == 1


def test_unqualified_page_is_dropped(spark):
    assert place_pages(pages(spark, "<p>nothing</p>", "", place(name="<H1>upper</H1>"))).count() == 1
    assert place_pages(pages(spark, place(name='<div class="lfPIob DUwDvf">x</div>'))).count() == 1


def test_cards(spark):
    html = place(
        card()
        + card(text=None)
        + card(text=" &#xFEFF;<br>")
        + card(text="b", user=None, stars=None, time=None)
        + card(text="c", stars=0)
    )
    got = [(r.user_name, r.rating, r.text, r.time) for r in one(spark, html).reviews]
    assert got == [("Ann", 4, "bagus", "2 hari lalu"), ("Anonymous", 0, "b", ""), ("Ann", 0, "c", "2 hari lalu")]


def test_cap_comes_after_the_blank_filter(spark):
    html = place("".join(card(text="" if i % 2 else f"t{i}") for i in range(20)))
    assert [r.text for r in one(spark, html, card_cap=4).reviews] == ["t0", "t2", "t4", "t6"]
    assert len(one(spark, place("".join(card(text=f"t{i}") for i in range(410)))).reviews) == 400


def test_nested_cards_are_all_read(spark):
    html = place(card(text="outer", inner=card(text="inner")))
    assert [r.text for r in one(spark, html).reviews] == ["outer", "inner"]


def test_rendered_text():
    def text(html):
        page = _Page(html)
        return page.text(page.find((Css("div"),), (0, len(page.tags)))[0])

    assert text("<div> a <b>b</b>c\n d </div>") == "a bc d"
    assert text("<div>a<br>b<script>x</script></div>") == "a\nb"
    assert text("<div>a<div>b</div>c</div>") == "a\nb\nc"
    assert text("<div><p>a<p>b</div>") == "a\n\nb"
    assert text("<div><ul><li>a<li>b</ul></div>") == "a\nb"
    assert text("<div>&lt;b&gt; &copy;</div>") == "<b> ©"
    assert text("<div>") == ""
    assert text("<b><div>a</b> b</div>") == "a b"


def test_keys_of_other_types_pass_through(spark):
    df = spark.sql("select 1L id, timestamp_ntz'2024-01-01 00:00:00' t, date'2024-01-01' d, '<p>a<p>b' html")
    row = pick_elements(df, {"p": All((Css("p"),)), "h1": First((Css("h1"),))}).first()
    assert (row.id, row.p, row.h1, str(row.d)) == (1, ["a", "b"], None, "2024-01-01")


@pytest.mark.parametrize(
    "junk", ["<a", "<a '", '<a "', "<a ''", "<!--", "<!", "<div>", "</div>", "<div></b>", "<p class='", "<script", "<script>", "<li><b>"]
)
def test_broken_markup_costs_no_more_per_byte(junk):
    def seconds(n):
        start = time.perf_counter()
        page = _Page("<div>" + junk * n)
        page.text(0)
        return time.perf_counter() - start

    small = min(seconds(500) for _ in range(3))
    assert seconds(8000) < 16 * max(small, 0.002) * 6  # far below the 256 times of a quadratic pass


def test_attributes():
    page = _Page("""<a title="x > y" data-n='1 "2"' HREF=/p?a=1&amp;b=2 disabled>t</a><A class="c  d">u</A>""")
    assert page.attrs(0) == {"title": "x > y", "data-n": '1 "2"', "href": "/p?a=1&b=2", "disabled": ""}
    assert [page.text(i) for i in page.find((Css("a", ("d", "c")),), (0, len(page.tags)))] == ["u"]


@pytest.mark.parametrize(
    "make",
    [
        lambda n: '<div data-review-id="1"><span class="wiI7pd">x</span>' * n,
        lambda n: '<div data-review-id="1"><span class="wiI7pd">x' * n,
        lambda n: '<ul class="ZQ6we"><li class="hpLkke">x' * n,
        lambda n: '<div class="Gpq6kf NlVald">About ' * n,
        lambda n: '<div class="fontBodyMedium dmRWX"><span aria-hidden="true">4</span>' * n,
        lambda n: "<p><td>" + "<b>" * n + "<ul>" * n,
    ],
)
def test_picks_take_linear_time(make):
    def took(n):
        start = time.perf_counter()
        page = _Page(make(n))
        for p in PLACE_PICKS.values():
            page.pick(p)
        return time.perf_counter() - start

    assert min(took(8000) for _ in range(2)) < 12 * min(took(1000) for _ in range(2)) + 0.2


def test_nested_cards():
    inner = '<div data-review-id="1"><span class="d4r55 fontTitleMedium">Ann</span><span class="wiI7pd">good</span></div>'
    page = _Page(f'<div data-review-id="1">{inner}</div><div data-review-id="2"><span class="wiI7pd">so <span class="wiI7pd">bad</span></span></div>')
    cards = page.pick(PLACE_PICKS["cards"])
    assert [(c["user"], c["text"]) for c in cards] == [("Ann", "good"), (None, "so")]

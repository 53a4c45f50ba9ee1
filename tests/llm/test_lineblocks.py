import random
import time

import pytest

from huepoint.llm import lineblocks
from huepoint.llm.lineblocks import extract, main_text

LONG = "Some sentences of a story that is long enough to surge over the windows of short lines. "
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><article>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu a</a></li><li><a href="/b">Menu b</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><!-- <p>not this</p> --><div class='ad'>Buy now</div>
<article><h1>Head &amp; line</h1><p><b>First&nbsp;paragraph <i>with</i>
  <a href="x">a link</a>.<br>Second line<p>Short.</p><aside><p>Aside</p></aside><div id="ad-7">Advert</div><p>x &lt; y &#8212; z</p>
<form><p>Mail <input type=text></p><button>Send</button></form><section class="comments"><p>Reader says</p><div><p>hi</p></div></section><p>Last</p></article>
<div id="sidebar"><p>Side text</p></div><footer>&copy; us</footer></body></html>"""


def test_article_page():
    assert main_text(PAGE).split("\n") == ["Head & line", "First paragraph with a link. Second line", "Short.", "x < y — z", "Last"]


def test_without_article_the_distribution_decides():
    menu = "".join(f'<li><a href="/{i}">Entry number {i} of the menu</a></li>' for i in range(30))
    page = f"<body><ul>{menu}</ul><p>hm</p><div>{''.join(f'<p>{i} {LONG}</p>' for i in range(5))}</div><ul>{menu}</ul><p>end</p></body>"
    got = main_text(page).split("\n")
    assert [x for x in got if LONG.strip() in x] == [f"{i} {LONG}".strip() for i in range(5)]
    assert not any("Entry" in x for x in got)


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<nav>only menu</nav>", ""), ("<p>a<script>x", "a"), ("<p>a<!-- x", "a"), ("<article><p>a<p>b", "a\nb"), ("a < b <p>c", "a < b\nc"), ("<main><p>m</p></main><p>o</p>", "m"), ("<div class=ad>never closed<article><p>kept</p></article>", "kept"), ("<article><header><h1>H</h1></header><p>t</p></article>", "H\nt")])
def test_cases(page, want):
    assert main_text(page) == want


def test_nothing_is_cut_from_long_texts():
    page = "<article>" + "".join(f"<p>{i} {LONG}</p>" for i in range(20_000)) + "</article>"
    assert main_text(page).count("\n") == 19_999


def test_frame(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.text.count("\n")) for r in got) == [(0, 0), (1, 4), (1, 4)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sections_of_unequal_length_stay_without_article():
    adverts = "<div class=ad>Buy</div>" * 4
    links = "".join(f'<p><a href="/{i}">Link {i} to another page of this site</a></p>' for i in range(5))
    long, short = "".join(f"<p>{i} {LONG}</p>" for i in range(1000)), f"<p>Small. {LONG}</p>"
    got = main_text(f"<body><div>{long}</div>{adverts}<p>After the advert.</p>{links}<h2>Section</h2>{short}{adverts}<p>The end.</p></body>").split("\n")
    assert len(got) == 1004 and got[1000:] == ["After the advert.", "Section", f"Small. {LONG}".strip(), "The end."]


def story(r, n=None):
    return " ".join(r.choice(["one", "two", "three,", "four.", "cinq", "seis", "sieben"]) + str(r.randrange(99)) for _ in range(n or r.choice([1, 2, 9, 40])))


def generated(r, marked):
    """A page and its text, known from how it was made: end tags are left out at random where HTML lets them be."""
    ends = lambda tag: r.choice(["", f"</{tag}>"])
    noise = [
        lambda: f'<div class="{r.choice(["ad", "share-buttons", "newsletter", "comment-list"])}"><p>{story(r)}{ends("p")}<div><b>{story(r)}</b></div></div>',
        lambda: f"<aside><h3>{story(r)}</h3><ul><li>{story(r)}<li>{story(r)}</ul></aside>",
        lambda: f'<form action="?q=a>b"><p>{story(r)}</form>',
        lambda: f'<script>document.write("<p>{story(r)}</p>")</script><style>p > a {{}}</style><!-- <p>{story(r)} -->',
        lambda: f'<ul><li class="share">{story(r)}<li hidden>{story(r)}</ul>',
        lambda: f'<nav><nav>{story(r)}</nav><p class="short-form">{story(r)}</nav>',
        lambda: f'<p class="sponsored-post">{story(r)}',
    ]
    parts, want = [], []
    for _ in range(r.randrange(3, 12)):
        if r.random() < 0.4:
            parts.append(r.choice(noise)())
        kind, t = r.randrange(5), story(r, None if marked else 30)
        if kind == 0:
            parts.append(f"<p>{t}<br>{t}{ends('p')}")
            want.append(f"{t} {t}")
        elif kind == 1:
            items = [story(r, None if marked else 30) for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{x}{ends('li')}" for x in items) + "</ul>")
            want += items
        elif kind == 2:
            parts.append(f'<div class="{r.choice(["short-form", "search-results-explained", "story"])}"><p>{t} &amp; <i title="<p>">x</i>{ends("p")}</div>')
            want.append(f"{t} & x")
        elif kind == 3:
            parts.append(f"<table><tr><td>{t}{ends('td')}<td>{t}{ends('td')}{ends('tr')}</table>")
            want += [t, t]
        else:
            parts.append(f"<h2>{t}</h2>" + (f'<div class="rail"><article class="card"><p>{story(r)}</article></div>' if marked else ""))
            want.append(t)
    around = "".join(f'<a href="{i}">{story(r)}</a><br>' for i in range(9))
    tag = r.choice(["article", "main"]) if marked else "div"
    head = f"<head><title>{story(r)}</title>{ends('head')}<body>"
    return f"<!doctype html><html>{head}<header>{story(r)}</header><div>{around}</div><{tag}>{''.join(parts)}</{tag}><div id=footer><p>{story(r)}</div>", "\n".join(want)


@pytest.mark.parametrize("marked", [True, False])
def test_generated_pages(marked):
    """Against the text that each page was made from; omitted end tags, nested excluded parts, with and without a marked part."""
    for seed in range(300):
        page, want = generated(random.Random(seed), marked)
        assert main_text(page) == want, (seed, page)


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><p class="ad">Buy<p>Real text one<p>Real text two</article>', "Real text one\nReal text two"),
        ('<article><ul><li class="share">Share<li>x</ul><p>later</article>', "x\nlater"),
        ('<article><div class="search-results-explained"><p>one</div><p class="short-form">two</article>', "one\ntwo"),
        ("<article><p>Teaser</p></article><div>" + f"<p>{LONG}</p>" * 3 + "</div>", "\n".join(["Teaser"] + [LONG.strip()] * 3)),
        ('<article><p>one <span class="ad">buy <span>more</span> now</span> two</p></article>', "one two"),
        ('<div class="related"><article>no</article></div><article><p>yes and more</article>', "yes and more"),
        ("<article><p title='a>b'>t <b>u<p>v <a href=\"x", "t u\nv"),
        ('<article><p title="open>t</article>', "t"),
        ("<article>" + "<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>after</article>", "deep\nafter"),
    ],
)
def test_omitted_ends_and_names(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("piece", ["<a ", '<p class="', "<a '>'", "<", "<div>", "<!--", "<script>", "<![CDATA[", "<svg>", "<ul><li>", '<span class="ad">', "<p a=\"'>"])
def test_time_grows_with_the_page_only(piece):
    """A megabyte of tags that never close; a quadratic scan would take hours."""
    began = time.time()
    main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 60


WORDS = "Enough words of plain prose to count as a line of text on a page, and then a few more."


@pytest.mark.parametrize("depth", [10, 255, 256, 300, 2000])
def test_exclusion_at_any_depth(depth):
    page = "<body>" + "<div>" * depth + f"<nav><ul><li><a>Menu</a></li><li>Shop</li></ul></nav><p>{WORDS}</p><div class='sidebar'><div><p>{WORDS}</p></div></div><p>The end.</p>" + "</div>" * depth
    assert lineblocks.main_text(page) == f"{WORDS}\nThe end."


def test_deep_elements_end_with_their_own_tags():
    page = "<body>" + "<div>" * 300 + f"<nav><b>x<section>Menu</section></nav><p>{WORDS}</p><nav>open" + "</div>" * 45 + f"<p>{WORDS}</p>" + "</div>" * 255 + f"<p>{WORDS}</p>"
    assert lineblocks.main_text(page) == "\n".join([WORDS] * 3)


def test_links_in_prose_are_text():
    link = lambda x: f"<p><a href='#'>{x}</a></p>"
    body = f"<div><p>{WORDS}</p>{link('One line that is a link')}{link('Another one')}{link('And a third')}<p>Closing.</p></div>"
    assert lineblocks.main_text(f"<body>{body}</body>") == f"{WORDS}\nOne line that is a link\nAnother one\nAnd a third\nClosing."
    assert lineblocks.main_text(f"<body>{link(WORDS)}</body>") == WORDS
    assert lineblocks.main_text(f"<body><h1>Title</h1><p>{WORDS}</p>{link('Last line, a link')}</body>") == f"Title\n{WORDS}\nLast line, a link"


def test_a_long_run_that_does_not_surge_goes_from_an_article_too():
    links = "".join(f"<li><a href='#{i}'>Elsewhere {i}</a></li>" for i in range(12))
    page = f"<body><article><h1>T</h1><p>{WORDS}</p><p>So.</p><ul>{links}</ul></article><div><p>Outside of it.</p></div></body>"
    assert lineblocks.main_text(page) == f"T\n{WORDS}\nSo."
    assert lineblocks.main_text(f"<body><article><p>{WORDS}</p><ul><li><a>One</a></li><li>of two</li></ul><p>{WORDS}</p></article></body>") == f"{WORDS}\nOne\nof two\n{WORDS}"


def test_given_pages_do_not_need_their_article_tags():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist():
        bare = page
        for tag in ("article", "main"):
            bare = bare.replace(f"<{tag}", "<div").replace(f"</{tag}", "</div")
        assert lineblocks.main_text(bare) == lineblocks.main_text(page) != ""

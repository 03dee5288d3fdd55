"""Pages whose text stands inside something named like furniture."""

from __future__ import annotations

import pytest
from pressroom.llm import html_text

TEXT = "<p>" + "The river and its old stone bridge were quiet that morning. " * 6 + "</p>"
MENU = '<nav><a href="/">Home</a> <a href="/b">News</a></nav>'


@pytest.mark.parametrize("start", ["<form id='aspnetForm'>", "<form class='form'>", "<div class='site has-sidebar'>", "<div class='search'>", "<div class='legal'>"])
def test_wrapped_pages_keep_their_text(start):
    tag = start[1:].split()[0]
    for inner in (TEXT * 3, f"<article><h1>A title</h1>{TEXT * 3}</article>"):
        page = f"<body>{start}{MENU}{inner}<footer>All rights reserved</footer></{tag}></body>"
        got = html_text.main_blocks(page)
        assert sum("stone bridge" in b for b in got) == 3 and not any("rights" in b or "News" in b for b in got)


def test_header_names_inside_an_article():
    page = f"<article><div class='entry-header'><h1>The old bridge</h1></div>{TEXT * 2}<div class='comments'>{TEXT}</div></article>"
    got = html_text.main_blocks(page)
    assert got[0] == "The old bridge" and len(got) == 3


@pytest.mark.parametrize(
    "inline, left",
    [
        ("<span class=advert>BUY NOW</span>", ""), ("<label>Your name</label>", ""), ("<button>Send</button>", ""),
        ("<a class='share' href='#'>Share this</a>", ""), ("<span hidden>unseen</span>", ""), ("<select><option>One</option></select>", ""),
        ("<b class=advert>BUY <i>NOW</i></b>", ""), ("<b class=strong>kept</b>", " kept"),
    ],
)
def test_furniture_inside_a_line(inline, left):
    page = f"<body>{MENU}<article><h1>A title</h1>{TEXT}<p>word one two three four five six {inline} seven eight</p>{TEXT}</article></body>"
    got = html_text.main_blocks(page)
    assert [b for b in got if "word one" in b or "seven" in b] in ([f"word one two three four five six{left} seven eight"], ["word one two three four five six", "seven eight"])
    assert not any(x in " ".join(got) for x in ("BUY", "Your name", "Send", "Share", "unseen", "One"))


def test_furniture_that_wraps_lines_is_judged_as_a_whole():
    page = f"<body><span class='form'>{MENU}<p>Intro words here</p>{TEXT * 3}</span></body>"
    assert sum("stone bridge" in b for b in html_text.main_blocks(page)) == 3


@pytest.mark.parametrize("part", ["<main>x ", "<div class=ad>x ", "<article><span>x</b> ", "<p class=menu><i>x</div> ", "</q>x ", "<a href=x>", "<li>x"])
def test_time_grows_with_the_length_alone(part):
    """Pages of deep, open or stray elements: five thousand in under a second, and eight times as many in about eight times that."""
    import time

    took = []
    for n in (5_000, 40_000):
        start = time.perf_counter()
        html_text.main_blocks(part * n)
        took.append(time.perf_counter() - start)
    assert took[0] < 1 and took[1] < 8 * max(took[0], 0.1) * 3

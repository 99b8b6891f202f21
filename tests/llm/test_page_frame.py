import random
import time

import numpy as np
import pytest

from domainlake.llm.html import main_text, surges_and_dives

TEXT = "The harbour was rebuilt after the flood and now serves the whole coast again, with three piers. "
BODY = f"<h1>Harbour</h1><p>{TEXT * 3}</p><p>{TEXT * 2}</p>"
REST = "<nav><a href='/'>Home</a></nav><footer>Imprint and more</footer>"
COMMENTS = f"<div id='comments'><article class='comment'><p>A reader says: {TEXT * 9}</p></article></div>"


@pytest.mark.parametrize(
    "marks",
    ["site has-sidebar", "layout no-sidebar", "single-post comments-open", "layout sidebar-right", "page with_banner", "page widget", "header-left"],
)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "{}"])
def test_wrappers_are_no_frame(marks, inner):
    page = f"<html><body><div class='{marks}'><div class='{marks}'>{REST}{inner.format(BODY)}<aside>Other news</aside></div></div></body></html>"
    got = main_text(page).split("\n")
    assert got == ["Harbour", (TEXT * 3).strip(), (TEXT * 2).strip()]


def test_heading_of_an_article_stays():
    page = f"<body>{REST}<article><div class='post-header'><h1>Harbour</h1></div><p>{TEXT * 3}</p></article></body>"
    assert main_text(page).split("\n") == ["Harbour", (TEXT * 3).strip()]


def test_form_around_the_page():
    assert main_text(f"<body><form id='f'>{REST}<div>{BODY}</div></form></body>").startswith("Harbour\nThe harbour")


@pytest.mark.parametrize("article", ["<article>{}</article>", "<div>{}</div>"])
def test_frames_stay_frames(article):
    side = f"<div class='sidebar'><article><p>Teaser: {TEXT}</p></article></div><div class='sidebar-right'><p>Also: {TEXT}</p></div>"
    got = main_text(f"<body>{REST}{article.format(BODY)}{side}{COMMENTS}<div class='cookie-notice'>{TEXT * 20}</div></body>")
    assert got.split("\n") == ["Harbour", (TEXT * 3).strip(), (TEXT * 2).strip()]


def test_a_small_card_is_not_the_article():
    """A marked card beside an unmarked story."""
    story = "".join(f"<p>Sentence {k} of the story is this one here, and it goes on a little.</p>" for k in range(5))
    got = main_text(f"<body><div class='story'>{story}</div><article class='card'><p>Read next: boats</p></article></body>").split("\n")
    assert [line[:10] for line in got] == [f"Sentence {k}" for k in range(5)]
    both = main_text(f"<body><article>{BODY}</article><article>{story}</article><article class='card'><p>Read next: boats</p></article></body>")
    assert "Sentence 4" in both and "piers" in both and "boats" not in both


@pytest.mark.parametrize("mark", ["class='share-of-market'", "class='alert'", "id='related-work'", "class='social-history notice'", "class='comments-open'", "class='adBlocker'"])
def test_names_of_parts_of_an_article(mark):
    parts = [f"<h2>First</h2><p>{TEXT * 2}</p>", f"<div {mark}><h2>Second</h2><p>{TEXT * 4}</p></div>", f"<p>{TEXT}</p>"]
    got = main_text(f"<body>{REST}<article>{''.join(parts)}</article></body>").split("\n")
    assert got == ["First", (TEXT * 2).strip(), "Second", (TEXT * 4).strip(), TEXT.strip()]


@pytest.mark.parametrize("mark", ["class='share-buttons'", "class='post-comments'", "id='relatedPosts'", "class='ad-slot'", "class='newsletter'", "class='notice'", "aria-label='Related articles'"])
def test_frames_within_an_article(mark):
    got = main_text(f"<body><article>{BODY}<div {mark}><p>Sign up or leave</p></div></article></body>").split("\n")
    assert got == ["Harbour", (TEXT * 3).strip(), (TEXT * 2).strip()]


@pytest.mark.parametrize("menu", ["<nav><ul>{}</ul></nav>", "<ul class='menu'>{}</ul>", "<ul>{}</ul>"])
def test_a_short_last_paragraph_stays(menu):
    menus = menu.format("".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(6))) * 4
    got = main_text(f"<body><h1>Harbour</h1><p>{TEXT * 3}</p>{menus}<p>That was all there is.</p><ul><li><a href='/x'>More</a></li></ul></body>")
    assert got.split("\n") == ["Harbour", (TEXT * 3).strip(), "That was all there is."]


def test_links_in_running_text_stay():
    body = f"<p>{TEXT}<a href='/p'>The piers</a> are new.</p><p><a href='/q'>All of this line is one link of the article.</a></p><p>{TEXT}</p>"
    assert main_text(f"<body>{REST}<article>{body}</article></body>").count("\n") == 2
    got = main_text(f"<body>{REST}<div>{body}</div></body>").split("\n")
    assert got == [f"{TEXT}The piers are new.", TEXT.strip()]


def test_deep_and_long_pages_take_linear_time():
    nested = "<li><div class='post widget'>"
    def seconds(page):
        begin = time.process_time()
        main_text(page)
        return time.process_time() - begin
    assert seconds(nested * 36_000 + f"<p>{TEXT}</p>") < 10  # 1 MB of tags that are never closed
    assert seconds((nested + f"<b>{TEXT}</b>") * 8_000) < 10
    assert seconds("<div>" * 100_000 + TEXT + "</div></b>" * 100_000) < 10
    assert main_text(nested * 3000 + f"<p>{TEXT}</p>") == TEXT.strip()


def brute_stretches(lengths, window):
    """Lines that lie in a window with text, window by window."""
    inside = [any(sum(lengths[max(0, e - window + 1) : e + 1]) > 0 and e - window + 1 <= k <= e for e in [k]) for k in range(len(lengths))]
    return [k for k, x in enumerate(inside) if x]


def test_surges_and_dives_equal_windows_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 0, 5, 90]) for _ in range(rng.randrange(0, 25))]
        window = rng.randrange(1, 5)
        spans = surges_and_dives(np.array(lengths, dtype=np.int64), window)
        assert [k for a, b, _ in spans for k in range(a, b)] == brute_stretches(lengths, window)
        for a, b, peak in spans:
            assert peak == max(sum(lengths[max(0, e - window + 1) : e + 1]) for e in range(a, b))

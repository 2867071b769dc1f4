"""Article text is kept whole; deep and unclosed markup stays cheap."""

import time
import tracemalloc

import pytest

from fluxloom.llm.html_text import main_text

LONG = "This is a long paragraph, with commas, and it says a lot; it goes on. " * 6
SHORT = "A short one, here."


def page(body):
    return f"<html><body><nav><a>Home</a></nav>{body}<footer>x</footer></body></html>"


def joined(*blocks):
    return "\n\n".join(b.strip() for b in blocks)


@pytest.mark.parametrize("tag", ["section", "div"])
def test_both_parts_of_an_article(tag):
    first, second = [LONG] * 13, [LONG + "Two."] * 7
    body = "".join(f"<{tag}>" + "".join(f"<p>{t}</p>" for t in part) + f"</{tag}>" for part in (first, second))
    assert main_text(page(f"<article>{body}</article>")) == joined(*first, *second)
    assert main_text(page(f"<div>{body}</div>")) == joined(*first, *second)


def test_title_and_introduction_before_the_body():
    assert main_text(page(f"<article><h1>Title</h1><p>Intro, first.</p><div><p>{LONG}</p><p>{LONG}</p></div></article>")) == joined("Title", "Intro, first.", LONG, LONG)
    assert main_text(page(f"<div><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div></div>")) == joined("Title", LONG, LONG)


def test_short_paragraphs_beside_a_long_block():
    body = "".join(f"<p>{SHORT}</p>" for _ in range(30))
    assert main_text(page(f"<article>{body}<div>{LONG * 20}</div></article>")) == joined(*[SHORT] * 30, LONG * 20)


def test_paragraph_beside_a_table():
    cells = "".join(f"<tr><td>{LONG}</td></tr>" for _ in range(4))
    assert main_text(page(f"<main><p>{SHORT}</p><table>{cells}</table></main>")) == joined(SHORT, *[LONG] * 4)


def test_teasers_are_not_parts():
    teasers = "".join(f"<article><p>Teaser {i}, read on.</p></article>" for i in range(3))
    assert main_text(page(f"<article><p>{LONG}</p><p>{LONG}</p></article>{teasers}")) == joined(LONG, LONG)
    assert main_text(page(f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>")) == joined(LONG, LONG)


def test_deep_and_unclosed_pages():
    n = 20_000
    deep = "<div>" * n + f"<p>{LONG}</p>" + "</span></b></section>" * 1000 + "</div>" * n
    tracemalloc.start()
    begin = time.time()
    assert main_text(deep) == LONG.strip()
    assert main_text("<div>word, word. " * n).count("word, word.") == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and time.time() - begin < 20
    begin = time.time()
    assert main_text("<svg>" * 200_000 + "<p>Text, at last.</p>") == "Text, at last."
    assert main_text("</div>" * 200_000 + "<p>Text, at last.</p>") == "Text, at last."
    assert time.time() - begin < 10

"""Kinds of pages that differ from the plain frame: what is kept and what goes."""

from __future__ import annotations

import numpy as np
import pytest

from factloom.llm import html as pages

TREE = pages.train()
CASES = {
    "a wrapper named after the layout": ('<div class="layout has-sidebar"><article><p>Kept text here.</p></article><div class="sidebar">no</div></div>', "Kept text here."),
    "a wrapper with a part's name": ('<div class="sidebar"><main><p>Kept text here.</p></main></div>', "Kept text here."),
    "an attribute that ends in id": ('<article><p>one is here</p><div data-id="comments"><p>two is here</p></div></article>', "one is here\ntwo is here"),
    "a self-closed picture": ("<article><p>a <svg/> b</p><p>c <iframe/> d</p></article>", "a b\nc d"),
    "a formula": ("<article><p>a <math><mi>x</mi></math> b</p></article>", "a x b"),
    "readers' articles": ('<article><p>Kept text</p></article><article class="comment"><p>a reader says a long thing about all of it here</p></article>', "Kept text"),
    "an article that may be commented": ('<article class="post comments-open"><p>Kept text</p></article>', "Kept text"),
    "bare paragraphs": ("<p>Hello there</p><p>Good morning</p>", "Hello there\nGood morning"),
    "a quote that is not closed": ('<article><p class="x>Text one</p><p>Text two</p></article>', "Text one\nText two"),
    "a page that ends in a tag": ('<article><p>Kept</p><div class="x', "Kept"),
    "an aside inside": ("<article><p>Kept text of some length</p><aside><p>A side note of the page that is long enough to look like text</p></aside><p>More text</p></article>", "Kept text of some length\nMore text"),
    "cards of other articles": ('<main><p>Kept text</p><div class="related"><article><h3><a href=x>Other</a></h3></article></div></main>', "Kept text"),
    "a page in a form": ("<form><article><p>Kept text</p></article><label>Mail</label></form>", "Kept text"),
    "a list of sources": ("<article><p>Kept text</p><ul><li><a href=x>one source</a></li></ul></article>", "Kept text\none source"),
}


@pytest.mark.parametrize("name", CASES)
def test_kinds_of_pages(name):
    page, want = CASES[name]
    assert pages.main_text(f"<body><nav><a href=/>Home</a></nav>{page}<footer>us</footer></body>", TREE) == want
    assert pages.main_text(page, TREE) == want


def test_a_very_long_page():
    body = "".join(f"<p>paragraph {i} of the text</p>" for i in range(50_000))
    assert pages.main_text(f"<nav><a href=/>x</a></nav><article>{body}</article>", TREE).count("\n") == 49_999


def test_density_decides_where_names_do_not():
    x, y = pages.labelled_table()
    share = pages.importance(TREE, x, y)
    assert sum(share.values()) == pytest.approx(1.0)
    assert share["link_density"] > 0.2
    named = [k for k, f in enumerate(pages.FEATURES) if f.startswith(("boilerplate", "main")) or f == "page_marked"]
    bare = x[:, named].sum(axis=1) == 0
    # Among the blocks without any name or mark, links tell the sides apart.
    assert 0.1 < y[bare].mean() < 0.9 and np.mean((TREE.predict(x[bare]) >= 0.5) == y[bare]) == 1

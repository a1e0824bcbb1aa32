"""Main text of pages: features, decoding, inline parts, broken and large pages."""

import itertools
import random
import time

import numpy as np
import pytest

from tessella.llm import html_main

ALIKE = 8


def test_alike_counts_the_same_tag_only():
    nodes = html_main.parse("<html><body>" + "<p>some text here.</p>" * 220 + "<aside>links</aside></body></html>")
    rows = html_main.measure(nodes)
    got = {n.tag: rows[i, ALIKE] for i, n in enumerate(nodes)}
    assert got["aside"] == 1 and got["p"] == 220


def test_decode_finds_the_best_labelling():
    rng = random.Random(2)
    for _ in range(200):
        nodes = [html_main.Node("html", None)]
        for _ in range(rng.randint(0, 9)):
            nodes.append(html_main.Node(rng.choice(["div", "p", "form"]), rng.choice(nodes), hidden=rng.random() < 0.1))
        for i, n in enumerate(nodes):
            n.index = i
        odds = np.array([rng.uniform(-2, 2) for _ in nodes])
        banned = [n.hidden or n.tag in html_main.DROPPED for n in nodes]
        best = max(
            sum(o for o, k in zip(odds, keep, strict=True) if k)
            for keep in itertools.product([False, True], repeat=len(nodes))
            if all(not k or not banned[i] and (nodes[i].parent is None or keep[nodes[i].parent.index]) for i, k in enumerate(keep))
        )
        keep = html_main.decode(nodes, odds)
        assert abs(sum(o for o, k in zip(odds, keep, strict=True) if k) - best) < 1e-9


PROSE = "Many words of an article stand here, and some more of them. " * 5


def in_article(part):
    page = f"<html><body><article><h1>Its title is this</h1><p>{PROSE}</p>{part}<p>{PROSE}</p></article></body></html>"
    return html_main.main_text(page, html_main.trained()).split("\n")[2:-1]


def test_inline_adverts_and_hidden_parts_are_left_out():
    assert in_article("<p>One <span class='advert'>Buy now <span>cheap</span> here</span> two words, and so on.</p>") == ["One two words, and so on."]
    assert in_article("<p>One <ins class='ad sponsored'>x</ins>two <span hidden>no</span> three words, as said.</p>") == ["One two three words, as said."]
    assert in_article("<p>One <span class='ad'>never closed</p><p>Two words, and so on, are here.</p>") == ["One", "Two words, and so on, are here."]
    assert in_article("<p data-hidden='x'>One <em id='cat'>two</em> three words, as said.</p>") == ["One two three words, as said."]


def test_unclosed_elements_end_with_their_parent():
    for tag in ("svg", "math"):
        assert in_article(f"<div><{tag}><path><p>The second one, here, is long enough.</p></div>") == ["The second one, here, is long enough."]
    assert in_article("<div><template><b>no</b></div><p>The second one, here, is long enough.</p>") == ["The second one, here, is long enough."]


@pytest.mark.parametrize("page", ["<ul>" + "<li>word, word." * 100_000 + "</ul>", "<center>" * 30_000 + "x", "<li><ul>" + "<x>" * 8_000 + "<li>a" * 20_000, "<p>a</b>" * 100_000, "<svg>" * 30_000])
def test_large_pages_take_linear_time(page):
    began = time.process_time()
    html_main.main_text(page, html_main.trained())
    assert time.process_time() - began < 10

"""Pages that lose text if names or lengths decide alone, bad markup in proportion to its length, and the scores by brute force."""

from __future__ import annotations

import random
import time

import pytest

from tessera.llm.html import PARAGRAPHS, Tree, main_text

FIVE = "".join(f"<p>Paragraph number {i} of the article, with some words, and a comma or two, to be long enough.</p>" for i in range(5))
LEAD = "The lead says in a sentence or two what the whole of it is about, so that nobody has to read the rest of it."
LINES = main_text(f"<article>{FIVE}</article>")


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div class="content with-sidebar">{FIVE}</div>', LINES),
        (f'<div class="elementor-widget-container">{FIVE}</div>', LINES),
        (f'<div id="market-share-report">{FIVE}</div>', LINES),
        (f'<body><form action="x"><label>Find <input name="a"></label><select><option>b</select>{FIVE}</form></body>', LINES),
        (f'<article><p>Start of it.</p><div class="ad">{FIVE}</article>', "Start of it.\n" + LINES),
        (f'<div id="c">{FIVE}</div><h2>End</h2><p>Bye now.</p>', LINES + "\nEnd\nBye now."),
        (f'<div class="a">{FIVE}</div><section><h2>Two</h2><p>Short.</p></section>', LINES + "\nTwo\nShort."),
        (f'<div class="a">{FIVE}</div><ul><li><a href="/">One</a><li><a href="/">Two</a></ul>', LINES),
        (f'<article><p>Short post.</p></article><div class="ad">{FIVE}</div>', "Short post."),
        (f'<article><p>Short post.</p><div class="comments">{FIVE}</div></article>', "Short post."),
        (f'<article>{FIVE}<form><p>Sign up for more.</p></form></article>', LINES),
        # names that hold such a word, inside an article; its own headers; adverts and shares still go
        (f'<article>{FIVE}<section id="market-share"><h2>Share</h2><p>Of the market.</p></section></article>', LINES + "\nShare\nOf the market."),
        (f'<article>{FIVE}<section id="literature-search"><p>Of the library.</p></section></article>', LINES + "\nOf the library."),
        (f'<article><p class="notice-board">On the board.</p>{FIVE}</article>', "On the board.\n" + LINES),
        (f'<article><h2 class="header">Part one</h2>{FIVE}</article>', "Part one\n" + LINES),
        (f'<article><div class="entry-header"><h1>Title</h1></div>{FIVE}</article>', "Title\n" + LINES),
        (f'<article>{FIVE}<div class="inline-ad">Buy it.</div><div class="share">Tell all</div><div class="post-share"><a href="/">One</a> <a href="/">two</a></div></article>', LINES),
        # a lead beside the wrapper of the rest, nested wrappers with a paragraph each
        (f'<div><div><p>{LEAD}</p></div><div><div>{FIVE}</div></div></div><div><a href="/">Home</a></div>', LEAD + "\n" + LINES),
        (f'<div><p>{LEAD}</p><div><p>{LEAD}</p><div>{FIVE}</div></div></div><p>(c) me</p>', LEAD + "\n" + LEAD + "\n" + LINES),
        # a title before the article, a short second article; cards of links and linked titles go
        (f"<h1>Title</h1><article>{FIVE}</article>", "Title\n" + LINES),
        (f'<h1><a href="/">Site</a></h1><article>{FIVE}</article><article><p>Short, too.</p></article><article><a href="/">Card of one</a></article>', LINES + "\nShort, too."),
        ("", ""),
        ("<!-- only a comment", ""),
        ("plain < text & more", "plain < text & more"),
    ],
)
def test_what_stays(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("piece", ["<a ", "<a<", "<a href='", "<!", '<a ">"', "<b>", "<div>", "<nav><b>", "</x>", "<i><table><td><b></i>", "<!--", "<td>x", "<p>x<b>"])
def test_a_megabyte_of_bad_markup(piece):
    began = time.process_time()
    main_text(piece * (1_000_000 // len(piece)))
    main_text(piece * (100_000 // len(piece)) + ">")
    assert time.process_time() - began < (30 if piece in ("<div>", "<p>x<b>", "<td>x", "<b>", "<i><table><td><b></i>", "<nav><b>") else 5)


@pytest.mark.parametrize("page", ["<div>" * 500 + "<table>" + "<td>a cell of words" * 40_000, ("<div class='x-widget'><p>words, in it</p>" * 500 + "</div>" * 500) * 40])
def test_deep_pages_take_no_longer(page):
    began = time.process_time()
    assert main_text(page) is not None
    assert time.process_time() - began < 5


def test_scores_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        page, depth = [], 0
        for _ in range(rng.randint(3, 60)):
            kind = rng.random()
            if kind < 0.3 and depth < 8:
                page.append(rng.choice(["<div>", "<section>", "<td>", "<article>"]))
                depth += 1
            elif kind < 0.45:
                page.append(rng.choice(["</div>", "</section>"]))
            else:
                words = "word, " * rng.randint(0, 12) + "x" * rng.randint(1, 40)
                page.append(rng.choice([f"<p>{words}</p>", words, f'<p><a href="/">{words}</a> and {words}</p>', f"<li>{words}</li>"]))
        tree = Tree.parse("".join(page))

        def inside(node, top):
            while node > top:
                node = tree.parent[node]
            return node == top

        def up(node):
            out = []
            while node > 0:
                out.append(node)
                node = tree.parent[node]
            return out

        want = []
        for i in range(len(tree.tag)):
            points = 0.0
            for node, text, linked in tree.blocks:
                chain = up(node)
                chain = chain[1:] if tree.tag[node] in PARAGRAPHS else chain
                if i in chain:
                    worth = ((1 if len(text) >= 25 else 0.25) + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
                    points += worth / (1 if chain.index(i) == 0 else 2 if chain.index(i) == 1 else 3 * chain.index(i))
            here = [(len(t), k) for node, t, k in tree.blocks if inside(node, i)]
            total = sum(n for n, _ in here)
            want.append(points * (1 - sum(k for _, k in here) / total) if total else 0.0)
        assert tree.scores() == pytest.approx(want)

"""Main text against a plain scorer, articles that names don't hide, and the time of nested pages."""

import random
import time

import pytest

from weftline.llm import main_text as M

LONG = "A paragraph, with commas, of some length, that goes on, and on, for the points that it gives to its container. " * 2


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (f"<div class='content with-sidebar'><h1>T</h1><p>{LONG}</p></div>", ["T", LONG.strip()]),
        (f"<div class='social-history-article'><p>{LONG}</p></div>", [LONG.strip()]),
        (f"<article><div class='entry-header'><h1>Head</h1></div><p>{LONG}</p></article>", ["Head", LONG.strip()]),
        (f"<article><header><h1>Head</h1></header><p>{LONG}</p><section class='related-work'><p>Other work.</p></section></article>", ["Head", LONG.strip(), "Other work."]),
        (f"<article><h1>T</h1><p>short</p><section>{f'<p>{LONG}</p>' * 10}</section><section><p>brief</p></section></article>", ["T", "short", *[LONG.strip()] * 10, "brief"]),
        (f"<div id='sidebar'><p>{LONG}</p></div>", [LONG.strip()]),
        (f"<div><h2>T</h2><div><p>{LONG}</p><p>{LONG}</p></div><ul><li>a<li>b</ul><ul><li><a href=x>link one</a></ul></div>", ["T", LONG.strip(), LONG.strip(), "a", "b"]),
        (f"<main><p>{LONG} <math><mi>x</mi></math></p></main><div class='site-header'><p>{LONG}</p></div>", [LONG.strip() + " x"]),
        (f"<div class='ad-hoc-report'>{f'<p>{LONG}</p>' * 3}</div><p>Tiny.</p>", [*[LONG.strip()] * 3, "Tiny."]),
        (f"<div id='comment-on-policy'>{f'<p>{LONG}</p>' * 3}</div><p>Tiny.</p>", [*[LONG.strip()] * 3, "Tiny."]),
        (f"<article><p>Tiny.</p></article><div class='comments'>{f'<p>{LONG}</p>' * 3}</div>", ["Tiny."]),
        (f"<form id=aspnet><nav>Menu</nav><div>{f'<p>{LONG}</p>' * 3}<label>Name</label><input></div></form>", [LONG.strip()] * 3),
        (f"<div><p>{LONG}</p></div><form><p>Write to us.</p><label>Name</label></form>", [LONG.strip()]),
        (f"<article><p>{LONG}</p><label>Figure label</label></article>", [LONG.strip(), "Figure label"]),
        (f"<div><section>{f'<p>{LONG}</p>' * 10}</section><section><p>brief</p></section><section><a href=x>links only</a></section></div>", [*[LONG.strip()] * 10, "brief"]),
        (f"<div><div class=title><h1>HEAD</h1></div><div class=body>{f'<p>{LONG}</p>' * 3}</div><div><a href=x>more</a></div></div>", ["HEAD", *[LONG.strip()] * 3]),
        (f"<article><p>{LONG}</p><div class='post-comments'><p>{LONG}</p></div></article>", [LONG.strip()]),
    ],
)
def test_articles(html, expected):
    assert M.main_text(html) == "\n\n".join(expected)


def plain(tree):
    """Score of each node of (tag, children or text) by the letter of the rule; the path of the best one."""
    found = {}

    def walk(node, path):
        tag, inside = node
        if isinstance(inside, str):
            own = 1 + inside.count(",") + min(M.MOST_BY_LENGTH, len(inside) / 100)
            for d in range(len(path)):
                up = path[: len(path) - 1 - d]
                points, chars, linked = found.get(up, (0, 0, 0))
                found[up] = (points + own / 2**d, chars + len(inside), linked + (len(inside) if tag == "a" else 0))
        else:
            for k, child in enumerate(inside):
                walk(child, (*path, k))

    walk(tree, ())
    return {p: points * (1 - linked / chars) for p, (points, chars, linked) in found.items()}


@pytest.mark.parametrize("seed", range(30))
def test_scores_by_the_letter(seed):
    random.seed(seed)

    def made(depth):
        if depth == 4 or (depth > 1 and random.random() < 0.4):
            return random.choice(["p", "p", "a"]), ", ".join("word" * random.randint(1, 20) for _ in range(random.randint(1, 9)))
        return "div", [made(depth + 1) for _ in range(random.randint(1, 4))]

    def html(node):
        tag, inside = node
        if isinstance(inside, str):
            return f"<p><a href=x>{inside}</a></p>" if tag == "a" else f"<p>{inside}</p>"
        return "<div>" + "".join(map(html, inside)) + "</div>"

    tree = ("div", [made(1) for _ in range(3)])
    reader = M._Reader(True)
    page = html(tree)
    text = M.main_text(page)
    scores = plain(tree)
    best = max(scores, key=lambda p: (scores[p], [-k for k in p]))
    node = tree
    for k in best:
        node = node[1][k]

    def texts(n):
        return [n[1]] if isinstance(n[1], str) else [t for c in n[1] for t in texts(c)]

    assert "\n\n".join(texts(node)) in text and reader.root.parent is None


@pytest.mark.parametrize("page", ["<div><p>x</p>" * 70_000, "<div>" * 150_000 + "<p>x</p>", "<span>" * 80_000 + "</div>" * 80_000, "<header>x" * 80_000])
def test_nested_pages_take_linear_time(page):
    began = time.perf_counter()
    M.main_text(page)
    assert time.perf_counter() - began < 5


def test_repeated_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1), (None, None, None, None)], "page_id long, url string, html string, N_chars long")
    got = M.extract(df)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert M.extract(df.limit(0)).isEmpty()

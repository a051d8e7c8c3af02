import html
import re
from itertools import product

import numpy as np
import pytest

from tarnwork.llm import extraction as X

PROSE = "This is a rather long paragraph of prose, with commas and a full stop, that any reader would take to be the main text. It goes on."


def text(page):
    return X.main_text(page.encode(), X.PRIOR)


def best_cut(gain, edges):
    """Least source side of all minimum cuts, by trying all."""
    found = []
    for side in product([False, True], repeat=len(gain)):
        cost = sum(-g if s else 0 for g, s in zip(gain, side)) + sum(c for a, b, c in edges if side[a] != side[b])
        found.append((cost, sum(side), side))
    least = min(found)[0]
    sides = [s for c, _, s in found if c == least]
    return [all(s[i] for s in sides) for i in range(len(gain))], least


def test_minimum_cut_equals_all_cuts():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        gain = rng.integers(-6, 7, n).tolist()
        edges = [(int(a), int(b), int(rng.integers(0, 6))) for a, b in rng.integers(0, n, (int(rng.integers(0, 2 * n)), 2)) if a != b]
        assert X.minimum_cut(gain, edges) == best_cut(gain, edges)[0]


def test_flow_on_a_grid_equals_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(60):
        gain = rng.integers(-3, 4, 12).tolist()
        edges = [(i, i + 1, 3) for i in range(11)] + [(i, i + 3, 2) for i in range(9)]
        assert X.minimum_cut(gain, edges) == best_cut(gain, edges)[0]


def test_long_chain_of_undecided_blocks():
    assert X.minimum_cut([2] + [0] * 20_000 + [-1], [(i, i + 1, 5) for i in range(20_001)]) == [True] * 20_002


@pytest.mark.parametrize("page,want", [
    (f'<div id="header"><h1>Site</h1><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></div><div class="cookie-notice">We use cookies.</div><div class="content"><h1>Title here</h1><p>{PROSE}<p>Short one.</p>'
     f'<div class="ad">Buy now!</div><ul><li>first item of it</li></ul></div><div class="sidebar"><p>{PROSE}</p></div><div id="comments"><div class="comment-body">{PROSE}</div></div><div class="footer">&copy; 2020</div>',
     f"Title here\n\n{PROSE}\n\nShort one.\n\nfirst item of it"),
    (f"<body><table><tr><td><a href=a>A</a><td><a href=b>B</a></table><div><p>{PROSE}</p><p>{PROSE}</p></div><div><a href=x>terms</a> | <a href=y>privacy</a></div>", f"{PROSE}\n\n{PROSE}"),
    (f'<main><header><h1>T</h1></header><p>{PROSE}</p><form>Name <input> <p>{PROSE}</p></form><section class="related"><article><p>{PROSE}</p></article></section></main><article class="comment">{PROSE}</article>', f"T\n\n{PROSE}"),
    (f'<article class="post hentry tag-search"><p>{PROSE}&nbsp;&lt;ok&gt; &amp &am<br>line <button>Share</button></p></article>', f"{PROSE} <ok> & &am line"),
    (f'<article><p>{PROSE}</p><p>end <a href="x', f"{PROSE}\n\nend"),
    (f'<article><script>if (a < b) "</p>"</script><style>p > a</style><p>{PROSE}</p><!-- <p>no</p> --><noscript><p>no</p></noscript><p hidden>no</p><p style="display: none">no</p>', PROSE),
    ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ("", ""), ("<nav>Home</nav>", ""), (PROSE, PROSE),
])
def test_pages(page, want):
    assert text(page) == want


def test_deep_and_long_pages():
    assert text("<div>" * 30_000 + PROSE + "</b>" * 30_000) == PROSE
    assert text("<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>").count(PROSE) == 20_000


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:h1|p)>", inside)]
        want[r["page_id"]] = (r["url"], "\n\n".join(p for p in parts if p))
    got = {r["page_id"]: (r["url"], r["text"]) for r in X.extract(pages).collect()}
    assert got == want


def test_classifier_tells_blocks_it_has_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    weights = X.train(pages)
    right = total = 0
    for r in pages.orderBy("page_id").limit(500).collect():
        found = X.blocks(r["html"].encode())
        for b, odds in zip(found, X.features(found) @ weights):
            if X.said(b) is not None:
                right, total = right + ((odds > 0) == X.said(b)), total + 1
    assert right / total > 0.85


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    page = f"<nav>x</nav><article><p>{PROSE}</p></article>"
    rows = [("t", 1, "u", page, 5), ("t", 1, "u", page, 6), ("t", None, None, page, 7), ("t", 2, "v", None, 8), ("t", 3, "w", "", 9)]
    df = spark.createDataFrame(rows, "text string, page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, X.extract(df).collect()), key=str)
    n = len(PROSE)
    assert got == sorted([(1, "u", PROSE, n), (1, "u", PROSE, n), (None, None, PROSE, n), (2, "v", "", 0), (3, "w", "", 0)], key=str)
    assert X.extract(df.limit(0)).count() == 0
    assert (X.train(df.limit(0)) == X.PRIOR).all()

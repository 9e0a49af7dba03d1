import random

import pytest

from auditlake.llm import html

LONG = "This is the text of the article and it is long enough to be seen as main text by any rule that we have."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words only", "plain words only"),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; us</footer></body>", f"Title\n{LONG}\nShort."),
        (f"<body><div class='ad'>Buy now</div><main><p><b>{LONG}<br>more<p>A &amp; B &lt;c&gt;&nbsp; d\n e</main>", f"{LONG} more\nA & B <c> d e"),
        (f"<header><p>Site</p></header><article><p>{LONG}</p><form><input><p>Name</p></form><script>var x = '<p>no</p>';</script><aside>See also</aside><p>End.</p></article><section id='comments'><article><p>{LONG}</p></article></section>", f"{LONG}\nEnd."),
        (f"<nav><a href='/'>Home</a><article><p>{LONG}</p></article>", LONG),
        (f"<div class='cookie-notice'>We use cookies</div><div class='content'><p>Lead</p><p>{LONG}</p><p>{LONG}</p><p>Tail</p></div><div class='sidebar'><p>{LONG}</p></div><div><a href='/a'>one link here</a></div>", f"Lead\n{LONG}\n{LONG}\nTail"),
        ("<article><p>1 < 2 and 3 > 2</p><!-- <p>hidden</p> --><p class='x\"y'>q</p></article", "1 < 2 and 3 > 2\nq"),
        ("<article><ul><li>first<li>second <i>it</i>em</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "first\nsecond item\na b\nc"),
        # names of states on the article, topics inside it, ids of headings and sections
        (f"<main class='has-sidebar'><p>{LONG}</p></main>", LONG),
        (f"<article class='post comments-open'><p>{LONG}</p></article>", LONG),
        (f"<article><p>{LONG}</p><section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section></article>", f"{LONG}\nDiscussion\n{LONG}"),
        (f"<article><p>{LONG}</p><h2 id='related-work'>Related work</h2><p>{LONG}</p></article>", f"{LONG}\nRelated work\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='search-algorithms'><h3>Search</h3><p>{LONG}</p></div><div class='share-buttons'>Share this</div></article>", f"{LONG}\nSearch\n{LONG}"),
        (f"<article><section class='discussion'><p>{LONG}</p><p>Short.</p></section></article>", f"{LONG}\nShort."),
        # what is set apart inside a paragraph takes its own text along
        (f"<article><p>{LONG} <a class='share'>Share</a> and <span class='hidden'>unseen</span> <sup class='reply'>1</sup>more.</p></article>", f"{LONG} and more."),
        (f"<article><p><span class='ad'>Buy</span></p><p>{LONG}</p></article>", LONG),
        # a marked teaser does not hide a longer article without a mark
        (f"<div class='content'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div><article><p><a href='/x'>Teaser text here.</a></p></article></div>", f"Title\n{LONG}\n{LONG}"),
        # reader comments marked as articles; self-closed elements; addresses without quotes
        (f"<main><p>{LONG}</p></main><div class='comments'><article class='comment'><p>{LONG}</p></article></div>", LONG),
        (f"<article><div class='ad'/><p>{LONG}</p><nav/><p>End.</p></article>", f"{LONG}\nEnd."),
        (f"<article><p>{LONG}</p></article><ul><li><a href=/a/>one link</a></ul>", LONG),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_ambiguous_blocks_inherit():
    assert html._second_pass([None, 1, None, None, 0, None], [1, 1, 1, 2, 2, 3]) == [1, 1, 1, 0, 0, 0]
    assert html._second_pass([1, None, 0], [1, 1, 2]) == [1, 1, 0]
    assert html._second_pass([None, None], [1, 2]) == [1, 1]


def plain_second_pass(labels, parents):
    """By definition, pair by pair."""
    out = []
    for i, label in enumerate(labels):
        if label is None:
            decided = [(abs(i - k), parents[k] != parents[i], -x, x) for k, x in enumerate(labels) if x is not None]
            label = min(decided)[3] if decided else 1
        out.append(label)
    return out


def test_second_pass_equals_its_definition():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.randrange(0, 14)
        labels, parents = [rng.choice([None, None, 0, 1]) for _ in range(n)], [rng.randrange(3) for _ in range(n)]
        assert html._second_pass(labels, parents) == plain_second_pass(labels, parents)


def test_first_pass_by_rule():
    """Density and length decide by themselves; names of places always; names of topics only without telling text."""
    s, few = html.Settings(), "zzz yyy xxx www vvv uuu ttt sss rrr qqq ppp ooo nnn mmm lll kkk jjj iii"
    cases = [
        (LONG, dict(), 1), (few, dict(), None), ("short", dict(), None), (few * 7, dict(), 1), (LONG, dict(linked=90), 0), (LONG, dict(frame=True), 0),
        ("short", dict(main=True), 1), ("short", dict(main=True, linked=5), None), (LONG, dict(weak=7), 1), ("short", dict(weak=7), None), ("short", dict(weak=8), 0), (few, dict(weak=9, main=True), 0),
    ]
    found = [(t, html._Block([], **(dict(linked=0, frame=False, weak=0, main=False, parent=0) | kw))) for t, kw, _ in cases]
    assert html._first_pass(found, s) == [x for *_, x in cases]


def test_pages(spark):
    rows = [(1, "u", "<article><p>Hallo é😀</article>", 5), (1, "u", "<article><p>Hallo é😀</article>", 5), (2, None, None, 6), (None, "v", "<p>" * 3000 + "x " * 200_000, 7)]
    got = html.extracted_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert [(r.page_id, r.url, r.text[:8], r.n_chars) for r in got] == [(1, "u", "Hallo é😀", 8)] * 2 + [(2, None, "", 0), (None, "v", "x x x x ", 399_999)]
    assert html.extracted_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

"""Operator 6: the cut against all labellings, and pages by hand."""

import itertools
import random

from lodestone.llm import op06_html as op

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="content"><article><h1>Head &lt;1&gt;</h1><p><b>First  line
of &eacute;t&#233; text&nbsp;here.<br><p>Second, <i>with</i> <a href="x">a link</a>.</p><div class="ad">Buy now, it is cheap and good.</div><p>Third one.</p><!-- <p>no</p> -->
<section class="comments"><p>I disagree with this text entirely.</p></section></article></div>
<aside>Other things to read.</aside><form><p>Your mail address here please.</p></form><footer>&copy; someone</footer></body></html>"""


def test_page():
    assert op.main_text(PAGE) == "Head <1>\nFirst line of été text here.\nSecond, with a link.\nThird one."


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 9)
        keep, drop = ([rng.randrange(12) for _ in range(n)] for _ in range(2))
        edges = {(a, b): rng.randrange(8) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def cost(labels):
            return sum(k if x else d for k, d, x in zip(keep, drop, labels)) + sum(w for (a, b), w in edges.items() if labels[a] != labels[b])

        assert cost(op.min_cut(keep, drop, edges)) == min(map(cost, itertools.product((False, True), repeat=n)))


def test_markup_of_articles():
    """What the article must keep and lose, whatever its markup."""
    around = lambda x: f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title here</h1><p>First sentence of this text, long enough to be one.</p>{x}<p>Last sentence of this text, long enough to be one.</p></article></body></html>"
    first, last = "Title here\nFirst sentence of this text, long enough to be one.", "Last sentence of this text, long enough to be one."
    cases = {
        "<p title=it's>Odd quote stands here.</p><p>Next isn't lost.</p>": "Odd quote stands here.\nNext isn't lost.",
        "<p>Text <svg width=1/>after a drawing.</p>": "Text after a drawing.",
        "<p>Text <svg><path d='M0'/><text>label</text></svg>after a drawing.</p>": "Text after a drawing.",
        "<p>Let <math><mi>x</mi></math> be a number.</p>": "Let x be a number.",
        "<p>Press <button>OK.</p><p>This comes after the button.</p>": "Press\nThis comes after the button.",
        "<p>See <object>the drawing of it</object> below.</p>": "See the drawing of it below.",
        "<p class='legal body'>The law says so in so many words.</p>": "The law says so in so many words.",
        "<script>if (a < b) '</p>'</script><style>p{}</style>": None,
        "<div class='advert'>Buy this now, it is cheap.</div>": None,
        "<ul><li>One point of the list.</li><li>Another point of it.</li></ul>": "One point of the list.\nAnother point of it.",
        "<p data-x=\"a > b\" title='c > d'>Quoted brackets stay inside.</p>": "Quoted brackets stay inside.",
        "<p>5 &lt; 6 &amp; 7 &#x3e; 2.</p>": "5 < 6 & 7 > 2.",
    }
    for markup, want in cases.items():
        assert op.main_text(around(markup)) == "\n".join([first, *([want] if want else []), last]), markup


def test_time_grows_with_the_page():
    import time

    pages = ["<div>" + "<p><a href='x'>A link of some words</a></p><p>Some text of a few words here.</p>" * 10_000 + "</div>", "<div>" * 20_000 + "deep text." + "</span></p>" * 20_000, "<p a=" + "'" * 100_000, "<" * 100_000, "<p =" * 50_000]
    began = time.thread_time()
    for page in pages:
        op.main_text(page)
    assert time.thread_time() - began < 20


def test_odd_pages(spark):
    pages = [None, "", "plain text only, no markup at all.", "<", "<p", "<!-- open", "<script>x", "<article><p>cut off &am", "<p>" * 3000, "<div>" * 3000 + "deep text.", "&#xD800; &#0; &bogus; x", "<article>" + "<p>word one two three.</p>" * 20_000 + "</article>"]
    frame = spark.createDataFrame([(i, None if i else "u", p, "x") for i, p in enumerate(pages + pages[2:3])], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in op.extract(frame).collect()}
    assert len(got) == len(pages) + 1
    assert got[0].text == got[1].text == got[6].text == "" and got[7].text == "cut off &am"
    assert got[11].text.count("\n") == 19_999 and got[11].n_chars == len(got[11].text)
    assert got[2].text == got[12].text
    assert op.extract(frame.limit(0)).count() == 0

import time
import itertools
import random

import pytest

from epochlake.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<div id="cookie-notice"><p>We use cookies to make this site better. Accept all?</p></div>
<header class="site-header"><h1>My Site</h1><p>The best site for everything, every day.</p></header>
<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<div class="wrap"><div class="post-content"><h2>The title</h2><p>First paragraph of the story,
  which is long enough &amp; good &#8212; caf&eacute;.<div class="advert">Buy now, it is a bargain for every reader.</div>
<p>A &lt;b&gt; and 1 < 2.<br>More   of it.</p><p>Short.</p><ul><li>One <b>it</b>em<li>Two items</ul><!-- no --></div>
<section id="comments"><h3>Comments</h3><p>I disagree with this whole article, it was a long read and I hated it.</p></section>
<form action=x><label>Your email</label><input name=q><p>Please enter your email address below to join the list.</p></form></div>
<aside><p>Related: another story that is long and looks like text, but sits in a sidebar.</p></aside>
<footer><p>&copy; 2020 some company or other.</p></footer></body></html>"""


def test_article_without_the_rest():
    assert h.extract(PAGE) == "The title\nFirst paragraph of the story, which is long enough & good — café.\nA <b> and 1 < 2. More of it.\nShort.\nOne item\nTwo items"


@pytest.mark.parametrize("html", [None, "", "<", "<p", "</p>", "<!-- x", "<script>x", "a<b", "<p>x</b></i></div>", "<table><tr><td>x<td>y", "<" * 1000, "<a href='x><p>y</p>", "&#xfffffff; &bogus; &"])
def test_broken_pages_do_not_fail(html):
    assert isinstance(h.extract(html), str)


def test_min_cut_is_minimal():
    r = random.Random(6)
    for _ in range(200):
        n = r.randrange(1, 8)
        costs = [r.choice([-3, -1, -0.5, 0, 0.5, 1, 3]) + r.random() / 9 for _ in range(n)]
        edges = [(*sorted(r.sample(range(n), 2)), r.random() * 2) for _ in range(r.randrange(9))] if n > 1 else []
        energy = lambda kept: sum((max(c, 0) if k else max(-c, 0)) for c, k in zip(costs, kept, strict=True)) + sum(w for i, j, w in edges if kept[i] != kept[j])  # noqa: B023, E731
        assert abs(energy(h.min_cut(costs, edges)) - min(map(energy, itertools.product((False, True), repeat=n)))) < 1e-6


def test_smoothness_keeps_a_short_block_with_its_neighbours():
    page = "<body><div>" + "".join(f"<p>{t}</p>" for t in ["A long paragraph with many words that says something about the matter at hand. " * 2, "ok", "And another long paragraph with as many words, which ends the page. " * 2]) + "</div></body>"
    assert h.extract(page).count("\n") == 2


@pytest.mark.parametrize("odd", ["</>", "</ div>", "</3 you>", "</é>", "</\n>"])
def test_text_after_a_nameless_end_tag_survives(odd):
    first, second = ("The %s paragraph of a story that is long enough to be read as content, with a full stop." % w for w in ("first", "second"))
    assert h.extract(f"<p>{first}{odd}</p><p>{second}</p>") == f"{first}\n{second}"
    # up to the next '>', as browsers read it
    assert h.extract(f"<p>{first} I </3 you</p><p>{second}</p>") == f"{first} I\n{second}"
    assert h.extract(f"<p>{first}</3 you") == first


STORY = ["The %s paragraph of a story that is told here at some length, so that it reads as content and ends as such." % w for w in ("first", "second", "third")]


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", '<div id="content">%s</div>', "<div>%s</div>"])
def test_a_form_around_the_page_keeps_its_content(around):
    rest = '<nav><a href=1>Home</a> <a href=2>News</a></nav>%s<div class="sidebar"><p>Another story that is long and looks like text, but sits in a sidebar.</p></div><input name=q>'
    page = f'<body><form method="post" id="aspnetForm">{rest % (around % "".join(f"<p>{t}</p>" for t in STORY))}</form><footer><p>Some company or other.</p></footer></body>'
    assert h.extract(page) == "\n".join(STORY)


def test_a_form_beside_the_content_is_left_out():
    lead = "<form><h3>Stay in touch</h3>" + "<p>Fill in this form and one of our many friendly advisers is going to call you back as soon as they can.</p>" * 2 + "<input name=q></form>"
    assert h.extract(f"<body><div>{''.join(f'<p>{t}</p>' for t in STORY)}</div>{lead}</body>") == "\n".join(STORY)


def test_table(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 2), (None, None, None, 3), (2, "", "", 4), (3, "x", "<p>" + "word " * 200_000, 5)]
    got = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert sorted(str((r.page_id, r.url, r.n_chars)) for r in got) == sorted(str((i, u, len(h.extract(p)))) for i, u, p, _ in rows)
    assert {r.text for r in got if r.page_id is None or r.page_id == 2} == {""}
    assert h.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


PROSE = [f"The committee met on Tuesday to discuss plan {i} for the river, and {i} of its members spoke at length about it." for i in range(20)]


@pytest.mark.parametrize("around", ["<div>{}</div>", "<div class='content'>{}</div>", "<article>{}</article>", "<section><div>{}</div></section>"])
def test_adverts_between_paragraphs_leave_them(around):
    inner = "".join(f"<p>{p}</p><div class='ad'>Buy our shoes now, number {i}</div>" for i, p in enumerate(PROSE))
    page = f"<body><nav><a href='/'>Home</a> <a href='/x'>News</a></nav>{around.format(inner)}<footer>&copy; us</footer></body>"
    assert h.extract(page).split("\n") == PROSE


def test_names_and_notices_of_other_languages():
    for bad in ("<div class='kommentare'><p>Ganz toll geschrieben, vielen Dank!</p></div>", "<div class='fuss'>Alle Rechte vorbehalten</div>", "<div id='commentaires'><p>Très bon article, merci.</p></div>", "<div class='publicidad'>Compre ahora</div>"):
        assert h.extract(f"<div><p>{PROSE[0]}</p><p>{PROSE[1]}</p>{bad}</div>") == "\n".join(PROSE[:2])


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<div>" + "<b>" * 50_000 + "x<hr>" * 50_000, "<li>" * 50_000 + "x", "<form>" * 20_000 + "<article>x" * 20_000, "<p>" * 50_000 + "</p>" * 50_000])
def test_time_grows_with_the_page(page):
    begin = time.process_time()
    h.extract(page)
    assert time.process_time() - begin < 3


def test_labelling_against_all_labellings():
    r = random.Random(4)
    parts = ["<p>{}</p>", "<div class='ad'>{}</div>", "<ul><li><a href='x'>{}</a></li></ul>", "<div><p>{}</p></div>", "<footer>{}</footer>", "<h2>{}</h2>"]
    for _ in range(60):
        page = "<div>" + "".join(r.choice(parts).format(r.choice(PROSE) if r.random() < 0.6 else "short words") for _ in range(r.randrange(1, 10))) + "</div>"
        blocks = h.blocks_of(page)
        costs, edges = [h.classifier_cost(b) for b in blocks], h.edges_of(blocks)
        energy = lambda kept: sum((max(c, 0) if k else max(-c, 0)) for c, k in zip(costs, kept, strict=True)) + sum(w for i, j, w in edges if kept[i] != kept[j])  # noqa: B023, E731
        best = min(energy(k) for k in itertools.product((False, True), repeat=len(blocks)))
        kept = h.min_cut(costs, edges)
        assert energy(kept) <= best + 1e-6
        assert h.extract(page) == "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)

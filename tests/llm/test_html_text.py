"""Site templates by subtree counts: what recurs on a host goes, whatever its name, and prose stays, whatever its name."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm import html_text
from sievewright.llm.scratch import table

SCHEMA = "page_id long, url string, html string"


def prose(rng, n=30):
    return " ".join(rng.choice("stone river light bread table winter garden letter market bridge".split()) + str(rng.randrange(1000)) for _ in range(n))


def site(pages=40, host="s.x", seed=1, shared=None):
    """Articles with unnamed menu, notice and comment, prose under odd names, and on a third of them a shared passage."""
    rng, rows, texts = random.Random(seed), [], []
    for i in range(pages):
        a, b, c, d = (prose(rng) for _ in range(4))
        passage = f"<p>{shared}</p>" if shared and i % 3 == 0 else ""
        body = f'<article><div class="q1"><a href="/a?{i}">Home</a> <a href="/b">All</a></div><h1>{a}</h1><div class="tags"><p>{b}</p></div>{passage}'
        body += f'<div class="q2"><p>Get our letter every week.</p></div><section id="related-work"><p>{c}</p></section><ul class="q3"><li>Great read, thank you!</li></ul><p>{d}</p></article>'
        rows.append((i, f"https://{host}/{i}", f"<html><body><div class=q4>{host} since 1999</div>{body}</body></html>"))
        texts.append(" ".join(x for x in (a, b, shared if passage else "", c, d) if x))
    return rows, texts


def texts_of(spark, rows):
    return {(r.url, r.page_id): r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_unnamed_templates_go_and_named_prose_stays(spark, monkeypatch):
    rows, want = site()
    got = texts_of(spark, rows)
    assert [got[r[1], r[0]] for r in rows] == want
    monkeypatch.setattr(html_text, "TEMPLATE_PAGES", 10**9)
    off = texts_of(spark, rows)
    assert all("Get our letter" in off[r[1], r[0]] and "Great read" in off[r[1], r[0]] for r in rows)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_a_passage_that_hosts_share_is_no_template(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", broadcast)
    rows, want = [], []
    for k, n in enumerate((90, 30, 30, 24, 12)):
        r, w = site(n, f"h{k}.x", k + 5, "A passage that many authors quote in full, whatever the site.")
        rows += [(1000 * k + i, u, h.replace("letter", f"letter of h{k}")) for i, u, h in r]
        want += [x.replace("letter", f"letter of h{k}") for x in w]
    got = texts_of(spark, rows)
    assert [got[r[1], r[0]] for r in rows] == want


def test_section_template_of_a_large_host(spark):
    rng, rows = random.Random(3), []
    for i in range(600):
        extra = "<div class=z><p>More from our gardening desk.</p></div>" if i % 24 == 0 else ""
        rows.append((i, f"https://{'small' + str(i % 7) if i % 3 else 'big'}.x/{i}", f"<body><article><p>{prose(rng)}</p>{extra}</article></body>"))
    got = texts_of(spark, rows)
    assert sum("gardening desk" in t for t in got.values()) == 0


def test_copies_of_an_article_are_no_template(spark):
    rows = [(i, f"https://s.x/{i}", f"<body><nav>{i}</nav><article><h1>One story</h1><p>{prose(random.Random(9))}</p></article></body>") for i in range(30)]
    got = texts_of(spark, rows)
    assert all(t.startswith("One story ") and len(t) > 100 for t in got.values())


def test_page_without_article(spark):
    rows = [(i, f"https://s.x/{i}", f"<html><body><div><a href=/>Start</a> our site since 1999</div><div>Story number {i}</div></body></html>") for i in range(12)]
    assert [t for _, t in sorted(texts_of(spark, rows).items(), key=lambda x: x[0][1])] == [f"Story number {i}" for i in range(12)]


def test_named_blocks_and_several_mains(spark):
    page = """<main><p>One.</p></main><aside>x</aside><main><p>Two.</p><div class="cookie-notice">We bake.</div><div id="comments"><p>Me too!</p></div>
    <div class="ad-hoc-analysis"><p>Three.</p></div><div class="related"><a href=/1>Else</a></div></main>"""
    comments = "<article><p>Text.</p><article class=comment><p>First!</p></article></article><section><article class=comment-item><p>Second!</p></article></section>"
    got = texts_of(spark, [(1, "u", page), (2, "v", comments)])
    assert got["u", 1] == "One. Two. Three." and got["v", 2] == "Text."


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "deep" + "</div>" * 60_000, "<b>" * 30_000 + "<p>" * 30_000 + "deep", "<a " * 100_000 + "deep", "<p>deep" + "</x>" * 200_000, "deep<a \"" * 40_000, "<!-- " * 100_000 + "-->deep", "deep<div class=" + "x" * 10**6 + ">"])
def test_odd_pages_end_soon(page):
    import time

    began = time.monotonic()
    html_text.text_of(html_text.parse(page))
    assert time.monotonic() - began < 10


def test_unfinished_ends():
    text = lambda page: html_text.text_of(html_text.parse(page))
    assert text("<p>a<p>b<div") == "a b" and text("<p>a<script>x</p>") == "a" and text("a <!-- <b> c") == "a" and text("1 < 2 and <b>3</b> tail") == "1 < 2 and 3 tail"


def test_candidates_on_the_pages(spark, sf):
    pages = table(spark, sf, "pages").select(F.lit("h").alias("host"), F.lit(0).cast("long").alias("version"), "html")
    assert pages.mapInArrow(html_text._subtrees, html_text.SUBTREES).where("subtree is not null").count() > pages.count()


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0

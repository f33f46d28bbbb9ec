"""Pages on which size, depth, stray quotes or unclosed tags must not decide what the article is."""

import random
import time

import pytest

from sparkloom.llm import html_text


def texts(spark, pages, host="one.example"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    found = html_text.main_text_table(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    return [r.text for r in found.orderBy("page_id").collect()]


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_long_comments_stay_out(spark):
    pages = [f"<body><article><h1>t{i}</h1><p>{words(i, 6)}</p><section class='comments'>{''.join(f'<p>{words(100 * i + k, 30)}</p>' for k in range(12))}</section></article></body>" for i in range(5)]
    assert texts(spark, pages) == [f"t{i} {words(i, 6)}" for i in range(5)]


@pytest.mark.parametrize("layout", ["sidebar", "comments", "ads", "related", "menu"])
def test_a_long_sidebar_is_no_article(spark, layout):
    pages = [f"<body><div class='top'><p>{words(i, 8)}</p></div><div class='{layout}'>{''.join(f'<p>{words(50 * i + k, 40)}</p>' for k in range(8))}</div></body>" for i in range(5)]
    assert texts(spark, pages) == [words(i, 8) for i in range(5)]


def test_groups_named_like_layout_that_enclose_the_article_stay(spark):
    pages = [f"<body class='has-sidebar'><div class='search content'><h1>h{i}</h1><p>{words(i, 20)}</p></div><div class='search'><p>{words(i + 9, 3)}</p></div></body>" for i in range(3)]
    assert texts(spark, pages) == [f"h{i} {words(i, 20)}" for i in range(3)]


@pytest.mark.parametrize("depth", [120, 400])
def test_an_article_deep_within_groups(spark, depth):
    pages = [f"<body><p>beside {i}</p>{'<div>' * depth}<article><h1>t{i}</h1><p>{words(i, 9)}</p></article>{'</div>' * depth}</body>" for i in range(3)]
    assert texts(spark, pages) == [f"t{i} {words(i, 9)}" for i in range(3)]
    assert texts(spark, [f"<body>{'<div>' * 3000}<p>{words(1, 4)}</p>"]) == [words(1, 4)]


def test_stray_quotes_belong_to_the_tag(spark):
    page = """<article><p>a <a href="x"">Link</a> b</p><p title="5" tall">Body</p><p class=a"b>C</p><p title='it"s'>D</p><p a = "1>2" b>E</p><p x=>F</p><p/>G<p =>H</p></article>"""
    assert texts(spark, [page]) == ["a Link b Body C D E F G H"]


def test_what_is_alike_elsewhere_stays_in_the_article(spark):
    pages = [f"<body><div>Contact</div><div class='body'><h2>Contact</h2><p>{words(i, 20)}</p><blockquote>Contact</blockquote></div></body>" for i in range(4)]
    assert texts(spark, pages) == [f"Contact {words(i, 20)} Contact" for i in range(4)]


@pytest.mark.parametrize("tag", ["svg", "template", "iframe", "select", "textarea", "noscript", "a href='", "p title=\"x", "div class"])
def test_unclosed_tags_take_linear_time(tag):
    page = f"<article><p>text</p>{f'<{tag}><b>x</b>' * (1_000_000 // (len(tag) + 10))}</article>"
    began = time.process_time()
    list(html_text.read(page))
    assert time.process_time() - began < 6


def test_swallowed_elements():
    read = lambda page: "".join(v for what, v, *_ in html_text.parse(page) if what == "text").split()
    assert read("a<svg/>b<svg viewBox='0 0 >'>no</svg >c<script>if (a < b) '</p>'</SCRIPT>d<style>x") == ["a", "bcd"]
    assert read("<p>a<script>no</script> b <template>no</template>c</p> <iframe>kept without an end") == ["a", "b", "c", "kept", "without", "an", "end"]
    assert read("x<!-- no --> y</ z>w <!doctype html>v<?php no ?>u") == ["x", "yw", "vu"]


def test_alignment_of_very_many_children_keeps_order():
    rng = random.Random(8)
    node = lambda k, lit: [f"div.k{k}", [], 3, False, False, lit]
    x, y = ([node(rng.randrange(30), rng.randrange(1, 90)) for _ in range(400)] for _ in range(2))
    x[:20], x[-10:] = y[:20], y[-10:]
    pairs = list(html_text._pairs(x, y))
    assert pairs[:20] == [(k, k) for k in range(20)] and pairs[-1] == (399, 399)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False)) and all(x[a][0] == y[b][0] for a, b in pairs)
    few = html_text._pairs(x[:60], y[:60])
    assert sum(html_text._worth(x[a], y[b]) for a, b in few) >= 60

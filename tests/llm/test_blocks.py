"""The block tree against labelled pages, held-out pages and the given table."""

from __future__ import annotations

import html
import re

import numpy as np

from linegrain.llm import blocks, queries

SF = "/root/testdata/sf0.001"
HELD_OUT = (
    (
        """<html><head><title>no</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
        <div class="top-menu"><a href="/">no</a><a>no</a></div><div role="alert">We use cookies on this page, please agree to all of them now.</div>
        <article><h1>A  title &amp; more</h1><p>First&nbsp;paragraph with &eacute; and<br>a break.</p><p>Second
        one <b>bold</b><i>it</i>.</p><!-- no --><div class='advert box'>Buy this very good thing today and save money</div><p>Third.</p></article>
        <aside>About the author, who has written many books about gardens and lives by the sea.</aside>
        <div id="user-comments"><p>I liked this article very much and will read it again soon.</p></div>
        <form><label>Mail</label><input value="no"><button>Send</button></form><footer>Imprint</footer></body></html>""",
        "A title & more\nFirst paragraph with é and a break.\nSecond one boldit.\nThird.",
    ),
    ("", ""),
    ("<nav><a>x</a></nav><footer>y</footer>", ""),
    ("<article>plain text &lt;tag&gt; 1 &#60; 2", "plain text <tag> 1 < 2"),
)


def test_held_out_pages():
    for page, want in HELD_OUT:
        assert blocks.main_text(page) == want


def test_head_without_end_tag():
    want = "A title\nFirst paragraph of it."
    article = "<article><h1>A title</h1><p>First paragraph of it.</p></article>"
    for head in (
        "<html><head><title>no</title><body>",
        "<html><head><title>no</title><meta charset=utf-8><link rel=x>",
        "<html><head><title>no<body class=x>",
        "<head><noscript><style>p{}</style>no<body>",
        "<head><head><title>no</title><script>no</script>",
        "<head><title>no <body> no</title><body>",
        "<head><template><p>no</p><body>no</template><title>no</title></head><body>",
        "<head><title>no <p> no</title></head><body>",
    ):
        assert blocks.main_text(head + article) == want, head
    plain = blocks.page_blocks("<head><title>no</title>Some <b>bold</b> words<p>and more")
    assert [b["text"] for b in plain] == ["Some bold words", "and more"]
    assert blocks.page_blocks("<head><title>no") == []


def test_leave_one_page_out():
    right = total = 0
    for i in range(len(blocks.LABELLED)):
        tree = blocks.grow(*blocks.labelled_rows(blocks.LABELLED[:i] + blocks.LABELLED[i + 1 :]))
        x, y = blocks.labelled_rows((blocks.LABELLED[i],))
        right += sum(blocks.decide(tree, tuple(r)) == k for r, k in zip(x, y, strict=True))
        total += len(y)
    assert right / total > 0.8


def test_query_takes_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op2_block_tree_text(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n".join(" ".join(x.split()) for x in parts if x.split())
        assert r.n_chars == len(r.text)


def test_edge_rows(spark):
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", long), (3, "u", '<a href="x>unclosed'), (4, "u", "<p " * 5_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS _row")
    found = blocks.extract(table).collect()
    assert len(found) == len(rows)
    assert sorted(r.n_chars for r in found)[-1] == 50_000 * 10 - 1
    assert blocks.extract(table.limit(0)).count() == 0
    assert np.all([r.text == "" for r in found if r._row.page_id == 1])

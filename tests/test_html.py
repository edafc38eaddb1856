"""H1-H3, H6, H7 on inline fixtures with hand-written expected output."""

import pytest
from pyspark.sql import functions as F

from mdforge.functions import html as H
from mdforge.operators import extract as X


def md(spark, html):
    df = spark.createDataFrame([(html,)], "h string")
    return df.select(H.html_to_markdown("h").alias("m")).first().m


def test_inline_formatting(spark):
    got = md(spark, '<h2>Title</h2><p>Hello <b>bold</b> and <em>it</em> and <code>x=1</code> <del>old</del></p>'
                    '<ul><li>one</li><li>two <a href="/x">link</a></li></ul>')
    assert got == "## Title\n\nHello **bold** and _it_ and `x=1` ~~old~~\n\n- one\n- two [link](/x)"


def test_ordered_list_quote_rule_code(spark):
    got = md(spark, "<ol><li>first</li><li>second</li></ol><blockquote><p>quote one</p><p>quote two</p></blockquote>"
                    "<hr><pre><code>def f():\n    return 1\n</code></pre><p>after</p>")
    assert got == "1. first\n2. second\n\n> quote one\n>\n> quote two\n\n---\n\n```\ndef f():\n    return 1\n```\n\nafter"


def test_table_tasks_images(spark):
    got = md(spark, '<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>'
                    '<ul><li><input type="checkbox" checked> done</li><li><input type="checkbox"> todo</li></ul>'
                    '<p><img src="a.png" alt="pic"> <a href="/p"><img alt="n" src="i.png"></a></p>')
    assert got == "| A | B |\n| --- | --- |\n| 1 | 2 |\n\n- [x] done\n- [ ] todo\n\n![pic](a.png) [![n](i.png)](/p)"


def test_entities_decoded_once(spark):
    assert md(spark, "<p>a &amp;lt; b &copy; &quot;q&quot;</p>") == 'a &lt; b © "q"'


# The reference's end-to-end fixture: title and h1 "Compat Smoke" in main > article.
SMOKE = ("<html><head><title>Compat Smoke</title></head><body><main><article><h1>Compat Smoke</h1>"
         "<p>Fetch path works.</p></article></main></body></html>")


def test_gate_and_limited(spark):
    rows = [
        (1, "http://a/1", SMOKE),
        (2, "http://a/2", "   "),
        (3, "http://a/3", "<html><head><title>T</title></head><body><script>x()</script></body></html>"),
        (4, "http://a/4", "<body><p>" + "x" * 10 + "</p></body>"),
        (5, "http://a/5", "<body>" + "y" * 50 + "</body>"),
        (6, "http://a/6", "<body>" + "y" * 49 + "</body>"),
        (7, "http://a/7", SMOKE.replace("Fetch path works.", "Fetch path works, and the article is long enough.")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in X.content_gate(df).collect()}
    # 44 characters of article HTML: below the 50-character gate, so a limited page.
    assert out[1].status == "limited" and out[1].title == "Compat Smoke"
    assert out[1].markdown == "# Compat Smoke\n\n" + X.LIMITED_NOTE + "\n\nCompat SmokeFetch path works...."
    assert out[7].status == "ok" and out[7].title == "Compat Smoke"
    assert out[7].markdown == "# Compat Smoke\n\nFetch path works, and the article is long enough."
    assert out[2].status == "empty" and out[2].error == X.EMPTY_RESPONSE and out[2].markdown == ""
    assert out[3].status == "no_article" and out[3].error == X.NO_ARTICLE
    assert out[4].status == "limited" and out[4].title == "http://a/4"
    assert out[4].markdown == "# Page Content\n\n" + X.LIMITED_NOTE + "\n\n" + "x" * 10 + "..."
    assert out[5].status == "ok"
    assert out[6].status == "limited"


def test_boilerplate_removed(spark):
    html = ('<body><nav><a href="/n">nav</a></nav><div class="ad">buy</div><article><p>' + "word " * 20 +
            '</p></article><footer>foot</footer></body>')
    df = spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")
    r = X.content_gate(df).first()
    assert "nav" not in r.markdown and "buy" not in r.markdown and "foot" not in r.markdown
    assert r.markdown.startswith("word word")


def test_html_blocks(spark):
    html = "<h2>T</h2><ol><li>a &amp; b</li><li>c</li></ol><table><tr><th>H</th></tr></table>"
    df = spark.createDataFrame([(1, html)], "page_id long, content_html string")
    got = [(r.pos, r.tag, r.inner) for r in X.html_blocks(df).orderBy("pos").collect()]
    assert got == [(1, "h2", "T"), (2, "ol", ""), (3, "li", "a & b"), (4, "li", "c"), (5, "table", ""), (6, "tr", ""), (7, "th", "H")]


def test_numeric_references(spark):
    assert md(spark, "<p>it&#8217;s &#x2019; &#233;t&#233; &amp;#39; &#0;</p>") == "it’s ’ été &#39; &#0;"


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<ol><li>a<ul><li>b</li></ul></li><li>c</li></ol>", "1. a\n   - b\n2. c"),
        ("<ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ul>", "- a\n  1. b\n  2. c\n- d"),
        ('<ol start="3"><li>x</li><li>y</li></ol>', "3. x\n4. y"),
        ("<blockquote>a<blockquote>b</blockquote>c</blockquote>", "> a\n>\n> > b\n>\n> c"),
        ("<p>t</p><blockquote><p>q</p><p>r</p></blockquote><p>u</p>", "t\n\n> q\n>\n> r\n\nu"),
        ("<i><b>x</b></i>", "_**x**_"),
        ('<b>a <a href="http://x/">l</a></b>', "**a [l](http://x/)**"),
        ("<strong>a<br>b</strong>", "**a  \nb**"),
        ("<a data-href='/no' href=/yes>l</a>", "[l](/yes)"),
        ("<table><tr><th>h|1</th><th>i</th></tr><tr><td>a|b</td><td>c</td></tr></table>", "| h\\|1 | i |\n| --- | --- |\n| a\\|b | c |"),
        ("caf&eacute; 2&times;3 &laquo;q&raquo; &amp;lt; &#000008217; &nosuch; &#xD800;", "café 2×3 «q» &lt; ’ &nosuch; &#xD800;"),
    ],
)
def test_markdown_structure(spark, html, markdown):
    df = spark.createDataFrame([(html,)], "content_html string")
    assert X.html_to_markdown(df).first().markdown == markdown


def test_anchor_forms(spark):
    from mdforge.operators import links as L

    html = (
        "<a href='/single'>1</a><a href=/bare>2</a><A class=x HREF = \"/double?a=1&amp;b=2\">3</a><a data-href=\"/no\">4</a>"
        "<!-- <a href=\"/comment\">5</a> --><script>'<a href=\"/script\">'</script><abbr href=\"/abbr\">6</abbr>"
    )
    df = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert [r.link for r in L.dom_links(df).orderBy("pos").collect()] == ["http://h/single", "http://h/bare", "http://h/double?a=1&b=2"]


WORDS = "some words, and more of them, to make a text that counts, "


def content(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return X.main_content(df).first().content_html


def test_nested_article_does_not_end_the_outer_one(spark):
    inner = "a<article>in</article>zzz " + WORDS
    assert content(spark, f"<body><article>{inner}</article></body>") == inner.strip()


def test_best_article_wins_over_teasers(spark):
    real = f"<h1>T</h1><p>{WORDS * 4}</p><p>{WORDS * 3}end"
    teaser = "<article><h2>x</h2><p>Read this other, shorter story today</p></article>"
    assert content(spark, f"<body>{teaser}<article>{real}</article>{teaser}</body>") == real
    # Articles of like weight come together, in order.
    assert content(spark, f"<body><article>{real}</article>{teaser}<article>2{real}</article></body>") == f"{real}\n\n2{real}"


def test_links_and_names_lower_a_score(spark):
    links = "".join(f"<li><a href=/{k}>{WORDS}</a>" for k in range(20))
    got = content(spark, f"<body><div><ul>{links}</ul></div><div><p>{WORDS}</p></div></body>")
    assert got == f"<p>{WORDS}</p>"
    assert content(spark, f"<body><div class='sidebar'><p>{WORDS * 3}</p></div><div id=content><p>{WORDS}</p></div></body>") == f"<p>{WORDS}</p>"


def test_content_without_a_text_that_counts(spark):
    assert content(spark, "<body><article><p>few</p></article></body>") == "<p>few</p>"
    assert content(spark, "<p>no container " + WORDS + "</p>") == f"<p>no container {WORDS}</p>"
    assert content(spark, "<div><p>" + WORDS) == "<p>" + WORDS.strip()
    assert content(spark, None) is None and content(spark, "") is None


def test_events_nest_properly(spark):
    from mdforge.functions import dom

    html = "<ul><li>a<li><p>b<table><tr><td>c<td>d</b></li></table></ul></div><p>e<p title='x>y'>f"
    df = spark.createDataFrame([(html,)], "h string")
    evs = df.select(dom.expr(dom.events(dom.F.col("h"), dom.MARKDOWN_NAMES).sql).alias("e")).first().e
    stack, tree = [], []
    for e in evs:
        if e.k == "o":
            assert e.parent == (stack[-1][0] if stack else 0) and e.depth == len(stack) + 1
            stack.append((e.id, e.tag))
            tree.append((e.depth, e.tag))
        elif e.k == "c":
            assert stack.pop() == (e.id, e.tag)
    assert not stack
    assert tree == [(1, "ul"), (2, "li"), (2, "li"), (3, "p"), (3, "table"), (4, "tr"), (5, "td"), (5, "td"), (1, "p"), (1, "p")]
    assert [html[e["at"] : e["at"] + len(e.text)] for e in evs if e.k == "t"] == list("abcdef")


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("x<b> sp </b>y", "x **sp** y"),
        ("<b><i><s>deep</s></i></b>", "**_~~deep~~_**"),
        ("<b>a <b>b</b></b>", "**a b**"),
        ("<b>left open<p>next", "left open\n\nnext"),
        ("a<br>b<br><br>c<br></p>", "a  \nb\n\nc"),
        ("<code>a`b</code> <code></code><code>c</code>", "`` a`b `` `c`"),
        ("<pre>x\n\n\n  ```\n</pre>", "````\nx\n\n\n  ```\n````"),
        ("<blockquote><ul><li>a<pre>b\nc</pre></ul></blockquote>", "> - a\n>\n>   ```\n>   b\n>   c\n>   ```"),
        ("<ol start=9><li>a<p>b</p><li>c<p>d</p></ol>", "9. a\n\n   b\n10. c\n\n    d"),
        ("<ul>stray<li>a</li><ul><li>b</li></ul></ul>", "- stray\n- a\n  - b"),
        ("<li>alone", "- alone"),
        ("<table><caption>C</caption><tr><th align=center>h<th style='text-align:right'>i<tr><td>a<p>b|c</p><td><b>d</b></table>", "C\n\n| h | i |\n| :---: | ---: |\n| a b\\|c | **d** |"),
        ("<table><tr><td>o<table><tr><td>in</td></tr></table></td></tr></table>", "| o \\| in \\| \\| --- \\| |\n| --- |"),
        ("<a href='/x'> t </a><a href=/y><img src=i.png alt='p'></a><a>none</a>", "[t](/x) [![p](i.png)](/y)none"),
        ("<h2>a<br>b <em>c</em></h2>text", "## a b _c_\n\ntext"),
        ("&nbsp;<i>&nbsp;x</i>", "_x_"),
        ("", ""),
    ],
)
def test_markdown_bottom_up(spark, html, markdown):
    assert md(spark, html) == markdown


def test_block_tree(spark):
    df = spark.createDataFrame([(1, "<h2>T</h2><ul><li>a <b>b</b><ul><li>c</ul><li>d</ul>")], "page_id long, content_html string")
    got = [(r.pos, r.parent, r.depth, r.tag, r.post, r.markdown) for r in X.html_block_tree(df).orderBy("pos").collect()]
    assert got == [
        (1, 0, 1, "h2", 1, "## T"), (2, 0, 1, "ul", 6, "- a **b**\n  - c\n- d"), (3, 2, 2, "li", 4, "a **b**\n- c"),
        (5, 3, 3, "ul", 3, "- c"), (6, 5, 4, "li", 2, "c"), (7, 2, 2, "li", 5, "d"),
    ]
    for _, parent, _, _, post, _ in got:
        assert not parent or post < next(x[4] for x in got if x[0] == parent)


def test_states_of_folds_are_not_copied():
    # transform() copies what its function returns, aggregate() doesn't.
    from mdforge.functions import dom
    from mdforge.functions import sqltext as T

    for sql in (dom.rendered(T.col("html")).sql, dom.best_content(T.col("html")).sql):
        assert "transform(array(named_struct('name'" not in sql
    parts = dom.rendered(T.col("html")).sql
    assert not __import__("re").search(r"transform\(\w+\.`open`, \(\w+, \w+\) -> CASE WHEN \(\w+ = \(size", parts)

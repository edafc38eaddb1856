"""Registered queries: one Spark job per operator of the inventory, each over the whole
driver tables, plus the equivalent DuckDB SQL used as the correctness oracle.

Every Spark query takes ``(spark, sf_dir)`` and returns a DataFrame; every oracle is a
SQL string over the pre-registered views. Column names agree between the two.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.regex import Rx, rx_spark, rx_sql, sql_str
from ..operators import extract as X
from ..operators import links as L
from ..operators import policy as P
from ..operators import urls as UO
from ..sources.captures import scan_captures, table
from . import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _pages(spark, sf):
    return table(spark, sf, "pages")


@register("s1_scan_captures", "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages")
def s1_scan_captures(spark, sf):
    return scan_captures(spark, f"{sf.rstrip('/')}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


# ---------------------------------------------------------------------------
# HTML jobs
# ---------------------------------------------------------------------------

@register("h1_page_title", f"SELECT page_id, {H.page_title_sql('html')} AS title FROM pages")
def h1_page_title(spark, sf):
    return X.page_metadata(_pages(spark, sf)).select("page_id", "title")


_CONTENT_SQL = f"(SELECT page_id, url, html, {H.main_content_sql('html')} AS content_html FROM pages)"


@register(
    "h2_main_content",
    f"SELECT page_id, content_html, {H.html_text_sql('content_html')} AS text, length(content_html) AS n_content_chars "
    f"FROM {_CONTENT_SQL}",
)
def h2_main_content(spark, sf):
    df = X.main_content(_pages(spark, sf))
    return df.select("page_id", "content_html", "text", F.length("content_html").cast("long").alias("n_content_chars"))


@register(
    "h3_html_to_markdown",
    f"SELECT page_id, {H.html_to_markdown_sql('content_html')} AS markdown FROM {_CONTENT_SQL}",
)
def h3_html_to_markdown(spark, sf):
    return X.html_to_markdown(X.main_content(_pages(spark, sf))).select("page_id", "markdown")


# Articles inside the constructs that the driver's pages lack: an ordered list that starts
# at 2 and holds a bullet list, a quote in a quote, named references, a bar in a cell.
WRAP = (
    '<ol start="2"><li>first</li><li>',
    "<ul><li>caf&eacute; 2&times;3</li><li><i><b>both</b></i></li></ul></li><li>last</li></ol><blockquote>out<blockquote>",
    "</blockquote>tail</blockquote><table><tr><th>a|b</th></tr><tr><td>c<br>d</td></tr></table>",
)
_WRAPPED_SQL = (
    f"(SELECT page_id, {sql_str(WRAP[0])} || content_html || {sql_str(WRAP[1])} || content_html || {sql_str(WRAP[2])} AS content_html FROM {_CONTENT_SQL})"
)


# The article's own Markdown is that of flat paragraphs; what the structures around it make
# of its lines is written out here, apart from the engine's renderer.
_FLAT_SQL = f"(SELECT page_id, content_html, {H.html_to_markdown_sql('content_html')} AS md FROM {_CONTENT_SQL})"


def _indented_sql(e: str, n: int) -> str:
    return f"regexp_replace({e}, '\n([^\n])', '\n{' ' * n}\\1', 'g')"


def _quoted_sql(e: str) -> str:
    return f"array_to_string(list_transform(string_split({e}, '\n'), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), '\n')"


_QUOTE_SQL = "'out\n\n' || " + _quoted_sql("md") + " || '\n\ntail'"


@register(
    "h3_markdown_structures",
    f"""SELECT page_id, '2. first\n3. ' || {_indented_sql("md || '\n- café 2×3\n- _**both**_'", 3)} || '\n4. last\n\n' ||
    {_quoted_sql(_QUOTE_SQL)} || '\n\n| a\\|b |\n| --- |\n| c d |' AS markdown FROM {_FLAT_SQL}""",
)
def h3_markdown_structures(spark, sf):
    body = X.main_content(_pages(spark, sf))
    wrapped = F.concat(F.lit(WRAP[0]), F.col("content_html"), F.lit(WRAP[1]), F.col("content_html"), F.lit(WRAP[2]))
    return X.html_to_markdown(UO.barrier(body.select("page_id", wrapped.alias("content_html")))).select("page_id", "markdown")


# Deeper: a quote in a list in a list, code with backticks and blank lines in an item, marks
# in marks with white space inside them, breaks, a caption, alignments, marks in cells, tags
# that are left open, and end tags of nothing.
NEST = (
    "<ul><li><b>one <i> two <s>three</s></i></b><ol start=9><li>nine<blockquote>",
    "</blockquote><li>ten<pre><code>x = `a`\n\n  ```y\n</code></pre></ol><li><p>loose</p><p>a<br>b<br></p></li></ul></i>",
    "<table><caption>Sum</caption><tr><th align=left>L<th style='text-align: right'>R<th>N</tr><tr><td><b>x</b><p>y</p><td>"
    "<code>a``b</code><td><a href='/u?a=1&amp;b=2'> <em>t</em></a>z</table></div><p>1<p>2 <b>open<div>3</div>4",
)


@register(
    "h3_markdown_nesting",
    f"""SELECT page_id,
    '- **one _two ~~three~~_**\n  9. nine\n\n     ' || {_indented_sql(_quoted_sql("md"), 5)} ||
    '\n  10. ten\n\n      ````\n      x = `a`\n      \n        ```y\n      ````\n- loose\n\n  a  \n  b\n\n' ||
    'Sum\n\n| L | R | N |\n| :--- | ---: | --- |\n| **x** y | ``` a``b ``` | [_t_](/u?a=1&b=2)z |\n\n1\n\n2 open\n\n3\n\n4' AS markdown FROM {_FLAT_SQL}""",
)
def h3_markdown_nesting(spark, sf):
    body = X.main_content(_pages(spark, sf))
    nested = F.concat(F.lit(NEST[0]), F.col("content_html"), *[F.lit(x) for x in NEST[1:]])
    return X.html_to_markdown(UO.barrier(body.select("page_id", nested.alias("content_html")))).select("page_id", "markdown")


# Pages around the article of each driver page, in four layouts: after a teaser, around a
# comment that is an article too, in a div beside a list of links, and twice in a row.
_CLOSING = "<p>The closing words, of this page, are long, full, and plain.</p>"
_TEASER = "<article class='teaser'><h2>Other</h2><p>See more of this other story, today</p></article>"
_COMMENT = "<article class='comment'><p>A reader said, a while ago, that this is fine.</p></article>"
_LINKS = "<div id=menu><ul>" + "".join(f"<li><a href='/{k}'>A link, to some other page, number {k}</a>" for k in range(9)) + "</ul></div>"
LAYOUTS = (
    (_TEASER + "<article>", "</article>"),
    ("<article>", _COMMENT + "</article>"),
    ("<div>" + _LINKS + "<div class='story'>", "</div></div>"),
    ("<article>", "</article>"),
)


def _in_layouts(df: DataFrame) -> DataFrame:
    body = F.concat("content_html", F.lit(_CLOSING))
    layout = F.pmod("page_id", F.lit(4))
    page = F.coalesce(*[F.when(layout == k, F.concat(F.lit(a), body, F.lit(b))) for k, (a, b) in enumerate(LAYOUTS)])
    twice = F.when(layout == 3, F.concat(F.lit("<article>"), body, F.lit("</article>"))).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><body><header>Top</header>"), page, twice, F.lit("<footer>End</footer></body></html>"))
    return UO.barrier(df.select("page_id", html.alias("html")))


_LAYOUT_SQL = (
    f"(SELECT page_id, CASE page_id % 4 WHEN 1 THEN b || {sql_str(_COMMENT)} WHEN 3 THEN b || '\n\n' || b ELSE b END AS content_html "
    f"FROM (SELECT page_id, content_html || {sql_str(_CLOSING)} AS b FROM {_CONTENT_SQL}))"
)


@register("h2_article_layouts", f"SELECT page_id, content_html, {H.html_text_sql('content_html')} AS text FROM {_LAYOUT_SQL}")
def h2_article_layouts(spark, sf):
    pages = _in_layouts(X.main_content(_pages(spark, sf)))
    return X.main_content(pages).select("page_id", "content_html", "text")


_GATE_SQL = f"""(SELECT *, CASE WHEN html IS NULL OR {H.trim_ws_sql('html')} = '' THEN 'empty'
  WHEN content_html IS NULL THEN 'no_article' WHEN length({H.trim_ws_sql('content_html')}) < {X.MIN_CONTENT_CHARS} THEN 'limited'
  ELSE 'ok' END AS status, {H.page_title_sql('html')} AS title, {H.html_text_sql('content_html')} AS text FROM {_CONTENT_SQL})"""


@register(
    "h6_content_gate",
    f"""SELECT page_id, status, CASE status WHEN 'empty' THEN '{X.EMPTY_RESPONSE}' WHEN 'no_article' THEN '{X.NO_ARTICLE}'
  WHEN 'limited' THEN '{X.LIMITED_ERROR}' END AS error FROM {_GATE_SQL}""",
)
def h6_content_gate(spark, sf):
    return X.content_gate(_pages(spark, sf)).select("page_id", "status", "error")


_LIMITED_SQL = (
    f"'# ' || coalesce(nullif(title, ''), '{X.DEFAULT_HEADING}') || '\n\n{X.LIMITED_NOTE}\n\n' || "
    f"CASE WHEN text IS NULL OR text = '' THEN '{X.NO_TEXT}' ELSE substr(text, 1, {X.LIMITED_TEXT_CHARS}) || '...' END"
)


@register(
    "h7_limited_page",
    f"SELECT page_id, coalesce(nullif(title, ''), url) AS limited_title, {_LIMITED_SQL} AS limited_markdown FROM {_GATE_SQL}",
)
def h7_limited_page(spark, sf):
    df = X.limited_page(X.main_content(X.page_metadata(_pages(spark, sf))))
    return df.select("page_id", "limited_title", "limited_markdown")


# ---------------------------------------------------------------------------
# URL jobs
# ---------------------------------------------------------------------------

_PARTS_SQL = ", ".join(f"{U.url_part_sql('url', n)} AS {n}" for n in U.PARTS)


@register("u1_url_inventory", f"SELECT page_id, {_PARTS_SQL}, {U.url_origin_sql('url')} AS origin FROM pages")
def u1_url_inventory(spark, sf):
    return UO.url_inventory(_pages(spark, sf).select("page_id", "url")).select("page_id", *U.PARTS, "origin")


@register(
    "u1_url_counts",
    f"SELECT scheme, host, count(*) AS n_urls FROM (SELECT {U.url_part_sql('url', 'scheme')} AS scheme, "
    f"{U.url_part_sql('url', 'host')} AS host FROM pages) GROUP BY scheme, host",
)
def u1_url_counts(spark, sf):
    return UO.url_counts(_pages(spark, sf))


@register("u2_normalize_urls", f"SELECT page_id, url, {U.normalize_url_sql('url')} AS url_key FROM pages")
def u2_normalize_urls(spark, sf):
    return UO.normalize_urls(_pages(spark, sf).select("page_id", "url"))


@register(
    "u3_dedupe_urls",
    f"""SELECT url_key, ord, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY ord) AS rn
  FROM (SELECT page_id, url, ord, {U.normalize_url_sql('url')} AS url_key FROM {D.url_variants_sql()})) WHERE rn = 1""",
)
def u3_dedupe_urls(spark, sf):
    v = UO.normalize_urls(D.url_variants(_pages(spark, sf)))
    return UO.dedupe_urls(v, key="url_key", order="ord").select("url_key", "ord", "page_id", "url")


def _hrefs(pages: DataFrame) -> DataFrame:
    """All anchor hrefs of each page with their position (1-based)."""
    hrefs = F.posexplode(L.href_array(F.col("html"))).alias("pos", "raw")
    return pages.select("page_id", F.col("url").alias("base"), hrefs).withColumn("pos", (F.col("pos") + 1).cast("int"))


def _hrefs_sql() -> str:
    return (
        f"(SELECT page_id, url AS base, CAST(generate_subscripts(hs, 1) AS INTEGER) AS pos, unnest(hs) AS raw FROM "
        f"(SELECT page_id, url, {L.href_array_sql('html')} AS hs FROM pages))"
    )


@register(
    "u4_resolve_links",
    f"SELECT page_id, pos, raw, target FROM (SELECT page_id, pos, raw, {U.resolve_url_sql('raw', 'base')} AS target "
    f"FROM {_hrefs_sql()}) WHERE target IS NOT NULL",
)
def u4_resolve_links(spark, sf):
    return UO.resolve_links(_hrefs(_pages(spark, sf))).select("page_id", "pos", "raw", "target")


@register(
    "u5_same_origin",
    f"""SELECT page_id, pos, target FROM (SELECT page_id, pos, base, {U.resolve_url_sql('raw', 'base')} AS target FROM {_hrefs_sql()})
  WHERE target IS NOT NULL AND {U.url_origin_sql('target')} = {U.url_origin_sql('base')}""",
)
def u5_same_origin(spark, sf):
    links = UO.resolve_links(_hrefs(_pages(spark, sf)))
    return UO.same_origin(links).select("page_id", "pos", "target")


# ---------------------------------------------------------------------------
# Policy jobs (host addresses derived from page hosts; IPv4 strings from documents)
# ---------------------------------------------------------------------------

_HA_SQL = f"(WITH {D.host_keys_cte()} SELECT * FROM {D.host_addresses_sql()})"


@register(
    "u6_url_policy",
    f"SELECT page_id, url, host, rule, reason, reason IS NULL AS allowed FROM "
    f"{P.url_policy_sql('(SELECT page_id, url FROM pages)', _HA_SQL)}",
)
def u6_url_policy(spark, sf):
    pages = _pages(spark, sf)
    ha = D.host_addresses(pages)
    return P.url_policy(pages.select("page_id", "url"), ha).select("page_id", "url", "host", "rule", "reason", "allowed")


# Malformed spellings of every page URL: where each piece goes and what is put there.
BAD_URLS = (
    (r"^(https?://)[^/?#]*", r"{1}[2606::1::2]"), (r"^(https?://)[^/?#]*", r"{1}[2606:4700::1xyz]"), (r"^(https?://)[^/?#]*", r"{1}[2606:4700::1%25eth0]"),
    (r"^(https?://[^/?#:]*)", r"{1}:99999"), (r"^(https?://[^/?#:]*)", r"{1}:abc"), (r"^(https?://[^/?#:]*)", r"{1}:0x50"), (r"^(https?://[^/?#:]*)", r"{1}:65535"),
)


def _bad_urls_sql() -> str:
    one = " UNION ALL ".join(f"SELECT page_id, {k} AS variant, {rx_sql('url', (Rx(a, b),))} AS url FROM pages" for k, (a, b) in enumerate(BAD_URLS))
    return f"({one})"


@register("u6_url_policy_malformed", f"SELECT page_id, variant, url, host, rule, reason FROM {P.url_policy_sql(_bad_urls_sql(), _HA_SQL)}")
def u6_url_policy_malformed(spark, sf):
    pages = _pages(spark, sf)
    variants = F.posexplode(F.array(*[rx_spark(F.col("url"), (Rx(a, b),)) for a, b in BAD_URLS])).alias("variant", "url")
    return P.url_policy(pages.select("page_id", variants), D.host_addresses(pages)).select("page_id", "variant", "url", "host", "rule", "reason")


# Other spellings that the URL standard reads as the page's own URL, or as a URL with a host
# whose ASCII form is written out here: (pattern, replacement, that host or none).
ODD_URLS = (
    (r"^(.*)\z", "  {1} \n", None),
    (r"^(https?):(//[^/?#]*)", "{1}:\t{2}\r\n", None),
    (r"^(https?)://", "{1}:", None),
    (r"^(https?)://", "{1}:////", None),
    (r"^(https?)://([^/?#]*)/?", r"{1}:\\{2}\\", None),
    (r"^(https?)://([^/?#]*)\.example\.", "{1}://{2}%2E%65xample.", None),
    (r"^(https?)://([^/?#]*)\.example\.", "{1}://{2}．ｅｘAMPLE。", None),
    (r"^(https?)://[^/?#]*", "{1}://%31%32%37.0.0.1", "127.0.0.1"),
    (r"^(https?)://[^/?#]*", "{1}://０x7f．１", "0x7f.1"),
    (r"^(https?)://[^/?#]*", "{1}://Bücher.日本語.example", "xn--bcher-kva.xn--wgv71a119e.example"),
    (r"^(https?)://[^/?#]*", "{1}://u\u0308ber.example", "xn--ber-goa.example"),
    (r"^(https?)://[^/?#]*", "{1}://ex%2Fa.example", "%"),
    (r"^(https?)://[^/?#]*", "{1}://a＠b.example", "%"),
    (r"^(https?)://[^/?#]*", "{1}://a%ff.example", "%"),
)


def _odd_urls_sql() -> str:
    """Every odd URL with the plain one it stands for; ``%`` is refused as a host."""
    one = []
    for k, (pattern, new, host) in enumerate(ODD_URLS):
        plain = "url" if host is None else f"regexp_replace(url, '^(https?)://[^/?#]*', '\\1://{host}')"
        if k == 4:  # the path's first slash is written out
            plain = "regexp_replace(url, '^(https?://[^/?#]*)/?', '\\1/')"
        one.append(f"SELECT page_id, {k} AS variant, {rx_sql('url', (Rx(pattern, new),))} AS odd, {plain} AS url FROM pages")
    return f"({' UNION ALL '.join(one)})"


@register(
    "u6_url_policy_standard",
    f"SELECT page_id, variant, odd AS url, CASE WHEN rule = 'invalid_url' THEN NULL ELSE host END AS host, rule, "
    f"CASE WHEN rule = 'invalid_url' THEN '{P.MSG_INVALID_URL}' || odd ELSE reason END AS reason FROM {P.url_policy_sql(_odd_urls_sql(), _HA_SQL)}",
)
def u6_url_policy_standard(spark, sf):
    pages = _pages(spark, sf)
    variants = F.posexplode(F.array(*[rx_spark(F.col("url"), (Rx(a, b),)) for a, b, _ in ODD_URLS])).alias("variant", "url")
    out = P.url_policy(pages.select("page_id", variants), D.host_addresses(pages))
    host = F.when(F.col("rule") != "invalid_url", F.col("host")).alias("host")
    return out.select("page_id", "variant", "url", host, "rule", "reason")


IPV4_IN_TEXT = r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b"


def _doc_ips(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(IPV4_IN_TEXT), 1)).alias("pos", "address")
    ).withColumn("pos", (F.col("pos") + 1).cast("int")).withColumn("family", F.lit(4))


def _doc_ips_sql() -> str:
    return (
        f"(SELECT doc_id, CAST(generate_subscripts(a, 1) AS INTEGER) AS pos, unnest(a) AS address, 4 AS family FROM "
        f"(SELECT doc_id, regexp_extract_all(text, {sql_str(IPV4_IN_TEXT)}, 1) AS a FROM documents))"
    )


@register(
    "u7_ipv4_policy",
    f"SELECT doc_id, pos, address, v4_num, blocked_range, error FROM {P.address_verdicts_sql(_doc_ips_sql())}",
)
def u7_ipv4_policy(spark, sf):
    v = P.address_verdicts(_doc_ips(table(spark, sf, "documents")))
    return v.select("doc_id", "pos", "address", "v4_num", "blocked_range", "error")


@register(
    "u8_ipv6_policy",
    f"SELECT host, address, checked_family, v6_hex, blocked_range, error FROM "
    f"{P.address_verdicts_sql('(SELECT * FROM ' + _HA_SQL + ' WHERE family = 6)')}",
)
def u8_ipv6_policy(spark, sf):
    ha = D.host_addresses(_pages(spark, sf)).filter(F.col("family") == 6)
    return P.address_verdicts(ha).select("host", "address", "checked_family", "v6_hex", "blocked_range", "error")


@register("u9_host_policy", f"SELECT host, n_addresses, error FROM {P.host_policy_sql(_HA_SQL)}")
def u9_host_policy(spark, sf):
    return P.host_policy(D.host_addresses(_pages(spark, sf)))


@register(
    "u10_policy_report",
    f"SELECT rule, count(*) AS n_urls, count(DISTINCT host) AS n_hosts FROM "
    f"{P.url_policy_sql('(SELECT page_id, url FROM pages)', _HA_SQL)} GROUP BY rule",
)
def u10_policy_report(spark, sf):
    pages = _pages(spark, sf)
    return P.policy_report(P.url_policy(pages.select("page_id", "url"), D.host_addresses(pages)))


# ---------------------------------------------------------------------------
# Link jobs (Markdown of the whole page body, navigation included, after its source
# comment; base = page URL)
# ---------------------------------------------------------------------------
_LINK_MD_SQL = f"(SELECT page_id, url, {D.link_markdown_sql('html', 'url')} AS md FROM pages)"


def _link_md(spark, sf):
    pages = _pages(spark, sf)
    return D.link_markdown(pages)


def _unnest_sql(arr: str) -> str:
    return (
        f"SELECT page_id, CAST(generate_subscripts(a, 1) AS INTEGER) AS pos, unnest(a) AS raw "
        f"FROM (SELECT page_id, {arr} AS a FROM {_LINK_MD_SQL})"
    )


@register("m1_inline_links", _unnest_sql(L.inline_link_array_sql("md")))
def m1_inline_links(spark, sf):
    return L.inline_links(_link_md(spark, sf), md="md")


@register("m2_bare_links", _unnest_sql(L.bare_link_array_sql("md")))
def m2_bare_links(spark, sf):
    return L.bare_links(_link_md(spark, sf), md="md")


_RESOLVED_SQL = (
    f"list_transform({L.inline_link_array_sql('md')} || {L.bare_link_array_sql('md')}, lambda x: {U.resolve_url_sql('x', 'url')})"
)


@register("m3_page_links", f"SELECT page_id, pos, link FROM {L.distinct_in_order_sql(_LINK_MD_SQL, 'page_id', _RESOLVED_SQL, 'link')}")
def m3_page_links(spark, sf):
    return L.page_links(_link_md(spark, sf), md="md", base="url")


_SAME_ORIGIN_SQL = f"list_filter({_RESOLVED_SQL}, lambda t: {U.url_origin_sql('t')} = {U.url_origin_sql('url')})"


@register(
    "m4_link_edges",
    f"SELECT e.page_id, p.url AS src, e.pos, e.dst FROM "
    f"{L.distinct_in_order_sql(_LINK_MD_SQL, 'page_id', _SAME_ORIGIN_SQL, 'dst')} e JOIN pages p USING (page_id)",
)
def m4_link_edges(spark, sf):
    return L.link_edges(_link_md(spark, sf), md="md", base="url")


_DOM_SQL = (
    f"list_filter(list_transform({L.href_array_sql('html')}, lambda h: "
    f"{U.resolve_url_sql('h', 'url', keep_absolute_raw=False)}), lambda t: t IS NOT NULL AND regexp_matches(t, '^https?://'))"
)


@register("h5_dom_links", f"SELECT page_id, pos, link FROM {L.distinct_in_order_sql('pages', 'page_id', _DOM_SQL, 'link')}")
def h5_dom_links(spark, sf):
    return L.dom_links(_pages(spark, sf))


# The same over pages whose anchors are respelled: single quotes, no quotes, another
# attribute that ends in href before it, and ampersands as references; the first anchor of
# each page stands once more in a comment and in a script.
FORMS = (
    (Rx(r'(?i)<a href="([^"]*)"', "<a href='{1}'"),),
    (Rx(r'(?i)<a href="([^" >]+)"', "<a href={1}"),),
    (Rx(r'(?i)<a href="([^"]*)"', '<a data-href="http://other.example/" href = "{1}"'),),
    (Rx(r'(?i)(<a href="[^"?]*\?[^"&]*)&([^"]*")', "{1}&amp;{2}"),),
)
HIDE = '<!-- <a href="http://hidden.example/c">x</a> --><script>"<a href=\'http://hidden.example/s\'>"</script>'


def _forms(spark, sf):
    html = F.posexplode(F.array(*[F.concat(F.lit(HIDE), rx_spark(F.col("html"), f)) for f in FORMS])).alias("form", "html")
    return _pages(spark, sf).select("page_id", "url", html)


_FORMS_SQL = "(" + " UNION ALL ".join(
    f"SELECT page_id, {k} AS form, url, {sql_str(HIDE)} || {rx_sql('html', f)} AS html FROM pages" for k, f in enumerate(FORMS)
) + ")"


@register("h5_dom_links_forms", f"SELECT page_id, form, pos, link FROM {L.distinct_in_order_sql(_FORMS_SQL, 'page_id, form', _DOM_SQL, 'link')}")
def h5_dom_links_forms(spark, sf):
    return L.dom_links(_forms(spark, sf), keep=("page_id", "form"))


# ---------------------------------------------------------------------------
# Chunk jobs: page Markdown (headings, blank lines) and documents (long prose)
# ---------------------------------------------------------------------------
from ..operators import chunks as CH  # noqa: E402

_PAGE_MD_SQL = f"(SELECT page_id, {H.html_to_markdown_sql('content_html')} AS markdown FROM {_CONTENT_SQL})"
PARAGRAPH_MAX = 1000


def _page_md(spark, sf):
    return X.html_to_markdown(X.main_content(_pages(spark, sf))).select("page_id", "markdown")


def _chunks_sql(src: str, key: str, arr: str, heading: bool) -> str:
    if heading:
        cols = "c.content AS content, CAST(ceil(length(c.content) / 4) AS INTEGER) AS tokens, c.headings AS headings, c.start_line AS start_line, c.end_line AS end_line"
    else:
        cols = "c AS content, CAST(ceil(length(c) / 4) AS INTEGER) AS tokens"
    return (
        f"SELECT {key}, chunk_index, {cols} FROM (SELECT {key}, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS chunk_index, "
        f"unnest(a) AS c FROM (SELECT {key}, {arr} AS a FROM {src}))"
    )


@register("m5_chunk_by_heading", _chunks_sql(_PAGE_MD_SQL, "page_id", CH.chunk_by_heading_sql("markdown"), True))
def m5_chunk_by_heading(spark, sf):
    return CH.chunk_by_heading(_page_md(spark, sf), "markdown", ("page_id",))


@register("m5_chunk_documents", _chunks_sql("documents", "doc_id", CH.chunk_by_heading_sql("text"), True))
def m5_chunk_documents(spark, sf):
    return CH.chunk_by_heading(table(spark, sf, "documents").select("doc_id", "text"), "text", ("doc_id",))


@register("m6_chunk_by_paragraph", _chunks_sql(_PAGE_MD_SQL, "page_id", CH.chunk_by_paragraph_sql("markdown", PARAGRAPH_MAX), False))
def m6_chunk_by_paragraph(spark, sf):
    return CH.chunk_by_paragraph(_page_md(spark, sf), "markdown", ("page_id",), PARAGRAPH_MAX)


@register("m7_chunk_by_sentence", _chunks_sql("documents", "doc_id", CH.chunk_by_sentence_sql("text"), False))
def m7_chunk_by_sentence(spark, sf):
    return CH.chunk_by_sentence(table(spark, sf, "documents").select("doc_id", "text"), "text", ("doc_id",))


@register(
    "m8_overlap_tail",
    f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tail_lines, array_to_string(t, chr(10)) AS tail FROM (SELECT doc_id, "
    f"list_transform([string_split(text, chr(10))], lambda ls: list_transform([{CH.overlap_count_sql('ls', CH.DEFAULT_OVERLAP)}], "
    f"lambda k: {CH._tail_sql('ls', 'k')})[1])[1] AS t FROM documents)",
)
def m8_overlap_tail(spark, sf):
    docs = table(spark, sf, "documents")
    t = CH.overlap_tail(F.split(F.col("text"), "\n"), CH.DEFAULT_OVERLAP)
    return docs.select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").cast("int").alias("n_tail_lines"), F.array_join("t", "\n").alias("tail")
    )


@register(
    "m9_estimate_tokens",
    "SELECT doc_id, length(text) AS n_chars, CAST(ceil(length(text) / 4) AS INTEGER) AS tokens FROM documents",
)
def m9_estimate_tokens(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), CH.estimate_tokens(F.col("text")).alias("tokens"))


# ---------------------------------------------------------------------------
# H8 flagship
# ---------------------------------------------------------------------------
from . import read_pages as RP  # noqa: E402


@register("h8_read_pages", RP.read_pages_table_sql())
def h8_read_pages(spark, sf):
    return RP.read_pages_table(spark, sf)


# ---------------------------------------------------------------------------
# Responses, redirects, robots, schedules (hops and rules derived from pages)
# ---------------------------------------------------------------------------
from ..operators import crawl as CR  # noqa: E402
from ..operators import combine as CB  # noqa: E402
from ..sources import cache as CA  # noqa: E402
from ..sources import export as EX  # noqa: E402
from ..sources.captures import classify_responses  # noqa: E402

_HOPS_SQL = D.hops_sql()


@register(
    "s2_classify_responses",
    f"""SELECT url, status, CASE WHEN status >= 300 AND status < 400 AND (location IS NULL OR location = '') THEN 'error'
  WHEN status >= 300 AND status < 400 THEN 'redirect' WHEN NOT (status >= 200 AND status < 300) THEN 'error'
  WHEN content_type IS NOT NULL AND NOT contains(content_type, 'text/html') AND NOT contains(content_type, 'application/xhtml+xml') THEN 'error'
  ELSE 'ok' END AS kind,
  CASE WHEN status >= 300 AND status < 400 AND (location IS NULL OR location = '') THEN 'Redirect without Location header for ' || url
  WHEN status >= 300 AND status < 400 THEN NULL WHEN NOT (status >= 200 AND status < 300) THEN 'HTTP ' || CAST(status AS VARCHAR) || ' for ' || url
  WHEN content_type IS NOT NULL AND NOT contains(content_type, 'text/html') AND NOT contains(content_type, 'application/xhtml+xml')
  THEN 'Non-HTML content type: ' || content_type || ' for ' || url END AS error FROM {_HOPS_SQL}""",
)
def s2_classify_responses(spark, sf):
    return classify_responses(D.hops(_pages(spark, sf))).select("url", "status", "kind", "error")


@register("s3_resolve_redirects")
def s3_resolve_redirects(spark, sf):
    pages = _pages(spark, sf)
    reqs = pages.select("url", F.col("page_id").alias("ord"))
    return CR.resolve_redirects(reqs, D.hops(pages), D.host_addresses(pages))


_ROBOTS_SQL = f"(WITH {D.host_keys_cte()} SELECT * FROM {D.robots_rules_sql()})"


# H8 over captures with response columns: every page URL is requested and its redirect
# chain followed; hops that no page stands for carry a short page of their own.
HOP_HTML = "<html><body><article><p>" + "moved here " * 8 + "</p></article></body></html>"


def _response_captures(pages: DataFrame) -> DataFrame:
    hops = D.hops(pages)
    return hops.join(pages.select("url", "page_id", "html"), "url", "left").withColumn("html", F.coalesce("html", F.lit(HOP_HTML))).withColumn(
        "page_id", F.coalesce("page_id", F.lit(1 << 40))
    )


_RESPONSES_SQL = (
    f"(SELECT h.url, coalesce(p.page_id, {1 << 40}) AS page_id, coalesce(p.html, {sql_str(HOP_HTML)}) AS html FROM {_HOPS_SQL} h LEFT JOIN pages p ON h.url = p.url)"
)


@register("h8_read_responses")
def h8_read_responses(spark, sf):
    pages = _pages(spark, sf)
    reqs = pages.select("url", F.col("page_id").alias("ord"))
    return RP.read_pages(reqs, _response_captures(pages), D.host_addresses(pages))


# H8 with a cache that holds every third page's result and the robots rules.
def _some_cached(spark, sf):
    entries = CA.cache_entries(RP.read_pages_table(spark, sf).filter(F.col("ord") % 3 == 0))
    return CA.latest_entries(entries).withColumn("markdown", F.concat(F.lit("cached: "), "markdown"))


@register("h8_read_cached_robots")
def h8_read_cached_robots(spark, sf):
    pages = _pages(spark, sf)
    reqs = pages.select("url", F.col("page_id").alias("ord"))
    return RP.read_pages(reqs, pages, D.host_addresses(pages), cache=_some_cached(spark, sf), robots_rules=D.robots_rules(pages), user_agent=D.ROBOTS_AGENT)



@register(
    "c3_robots_filter",
    f"SELECT page_id, url, robots_allowed, crawl_delay, robots_rule FROM "
    f"{CR.robots_filter_sql('(SELECT page_id, url FROM pages)', _ROBOTS_SQL, D.ROBOTS_AGENT)}",
)
def c3_robots_filter(spark, sf):
    pages = _pages(spark, sf)
    out = CR.robots_filter(pages.select("page_id", "url"), D.robots_rules(pages), user_agent=D.ROBOTS_AGENT)
    return out.select("page_id", "url", "robots_allowed", "crawl_delay", "robots_rule")


@register(
    "c4_crawl_schedule",
    f"""SELECT page_id, url, host, host_rank, crawl_delay, (host_rank - 1) * crawl_delay AS start_offset FROM (
  SELECT page_id, url, crawl_delay, {U.url_part_sql('url', 'host')} AS host,
  row_number() OVER (PARTITION BY {U.url_part_sql('url', 'host')} ORDER BY page_id) AS host_rank
  FROM {CR.robots_filter_sql('(SELECT page_id, url FROM pages)', _ROBOTS_SQL, '*')})""",
)
def c4_crawl_schedule(spark, sf):
    pages = _pages(spark, sf)
    out = CR.crawl_schedule(pages.select("page_id", "url"), D.robots_rules(pages), url="url", order="page_id")
    return out.select("page_id", "url", "host", "host_rank", "crawl_delay", "start_offset")


# ---------------------------------------------------------------------------
# Crawls over the linked pages (every page a seed) and the per-seed documents
# ---------------------------------------------------------------------------
CRAWL_MAX_PAGES = 3


def _crawl(spark, sf):
    pages = D.linked_pages(_pages(spark, sf))
    seeds = pages.select(F.col("url").alias("seed"))
    return CR.crawl_budget(seeds, pages, D.host_addresses(pages), max_pages=CRAWL_MAX_PAGES, same_origin_only=False)


@register("c1_crawl_budget")
def c1_crawl_budget(spark, sf):
    return _crawl(spark, sf)


# A budget that reaches further levels; the oracle runs the queue itself, step by step.
LONG_CRAWL = 6
LONG_COLS = ("seed", "ord", "request_url", "url", "title", "markdown", "error", "status", "seed_error")


@register("c1_crawl_budget_long")
def c1_crawl_budget_long(spark, sf):
    pages = D.linked_pages(_pages(spark, sf))
    seeds = pages.select(F.col("url").alias("seed"))
    return CR.crawl_budget(seeds, pages, D.host_addresses(pages), max_pages=LONG_CRAWL, same_origin_only=False).select(*LONG_COLS)


@register("c2_crawl_depth")
def c2_crawl_depth(spark, sf):
    pages = D.linked_pages(_pages(spark, sf))
    seeds = pages.select(F.col("url").alias("seed"))
    depth = 1 if CRAWL_MAX_PAGES > 1 else 0  # "pages > 1 means depth 1"
    out = CR.crawl_depth(seeds, pages, D.host_addresses(pages), depth=depth, same_origin_only=False)
    return out.withColumn("links", F.array_join("links", " "))


def _crawl_results(spark, sf):
    pages = D.linked_pages(_pages(spark, sf))
    return CR.crawl_depth(pages.select(F.col("url").alias("seed")), pages, D.host_addresses(pages), depth=1, same_origin_only=True)


@register("m10_combine_pages")
def m10_combine_pages(spark, sf):
    return CB.combine_pages(_crawl(spark, sf))


@register("m11_error_report")
def m11_error_report(spark, sf):
    return CB.error_report(_crawl(spark, sf))


@register("m12_read_summary")
def m12_read_summary(spark, sf):
    res = _crawl(spark, sf)
    links = F.when(F.col("status") == "ok", L.page_link_array(F.col("markdown"), F.col("request_url")))
    return CB.read_summary(res.withColumn("links", links)).withColumn("links", F.array_join("links", " "))


# ---------------------------------------------------------------------------
# Cache table and exports over the flagship results
# ---------------------------------------------------------------------------
_H8_SQL = f"({RP.read_pages_table_sql()})"
_ENTRIES_SQL = (
    f"(SELECT sha256({U.normalize_url_sql('url')}) AS url_key, url, title, markdown, "
    f"CAST(coalesce(strlen(markdown), 0) + coalesce(strlen(title), 0) AS BIGINT) AS n_bytes "
    f"FROM {_H8_SQL} WHERE error IS NULL AND markdown IS NOT NULL)"
)


def _entries(spark, sf):
    return CA.cache_entries(RP.read_pages_table(spark, sf))


@register("s5_cache_entries", f"SELECT url_key, url, title, n_bytes FROM {_ENTRIES_SQL}")
def s5_cache_entries(spark, sf):
    return _entries(spark, sf).select("url_key", "url", "title", "n_bytes")


@register(
    "s6_cache_lookup",
    f"""SELECT v.page_id, v.url, v.ord, e.url_key IS NOT NULL AS hit, e.title AS cached_title
  FROM {D.url_variants_sql()} v LEFT JOIN {_ENTRIES_SQL} e ON sha256({U.normalize_url_sql('v.url')}) = e.url_key""",
)
def s6_cache_lookup(spark, sf):
    variants = D.url_variants(_pages(spark, sf))
    entries = CA.latest_entries(_entries(spark, sf))
    return CA.cache_lookup(variants, entries, url="url").select("page_id", "url", "ord", "hit", "cached_title")


# Two writers, each with its own version, then a clear and a new put: the newer entry is
# read, and after the clear only what was put later.
@register("s5_cache_put_twice", f"SELECT url_key, url, 'second' AS title, n_bytes - coalesce(strlen(title), 0) + 6 AS n_bytes FROM {_ENTRIES_SQL}")
def s5_cache_put_twice(spark, sf):
    path, results = _scratch(spark, "cache"), RP.read_pages_table(spark, sf)
    for title in ("zz first", "second"):
        CA.cache_put(results.withColumn("title", F.lit(title)), path)
    return CA.read_cache(spark, path).select("url_key", "url", "title", "n_bytes")


@register("s8_cache_clear", f"SELECT url_key, url, n_bytes FROM {_ENTRIES_SQL} WHERE url LIKE 'https:%'")
def s8_cache_clear(spark, sf):
    path, results = _scratch(spark, "cache"), RP.read_pages_table(spark, sf)
    CA.cache_put(results, path)
    CA.cache_clear(spark, path)
    CA.cache_put(results.filter(F.col("url").startswith("https:")), path)
    return CA.read_cache(spark, path).select("url_key", "url", "n_bytes")


@register(
    "s7_cache_status",
    f"SELECT CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS cache_size, count(*) AS cache_files, "
    f"printf('%.2f MB', coalesce(sum(n_bytes), 0) / 1024.0 / 1024.0) AS cache_size_formatted FROM {_ENTRIES_SQL}",
)
def s7_cache_status(spark, sf):
    return CA.cache_status(CA.latest_entries(_entries(spark, sf)))


@register("s9_export_json")
def s9_export_json(spark, sf):
    return EX.export_json(RP.read_pages_table(spark, sf))


@register("s10_export_markdown")
def s10_export_markdown(spark, sf):
    return EX.export_markdown(CB.combine_pages(_crawl(spark, sf)))


@register(
    "s11_export_both",
    f"""SELECT ord, url, chr(10) || '## URL: ' || url || chr(10) || chr(10) ||
  CASE WHEN coalesce(markdown, '') <> '' THEN markdown || chr(10) ELSE '' END AS text,
  CASE WHEN error IS NOT NULL THEN CASE WHEN coalesce(markdown, '') <> '' THEN 'Warning' ELSE 'Error' END || ': ' || error END AS message
  FROM {_H8_SQL}""",
)
def s11_export_both(spark, sf):
    return EX.export_both(RP.read_pages_table(spark, sf))


@register("s9_export_json_crawl")
def s9_export_json_crawl(spark, sf):
    return EX.export_json(_crawl_results(spark, sf))


@register("s11_export_both_crawl")
def s11_export_both_crawl(spark, sf):
    return EX.export_both(_crawl_results(spark, sf))


# ---------------------------------------------------------------------------
# Streaming: pages arrive as files; each URL processed once; cache filled per batch
# ---------------------------------------------------------------------------
import uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..streaming import pages as ST  # noqa: E402


def _scratch(spark, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@register("t1_stream_read_pages")
def t1_stream_read_pages(spark, sf):
    pages = _pages(spark, sf)
    out = _scratch(spark, "t1-out")
    ST.stream_read_pages(ST.table_stream(spark, sf), out, _scratch(spark, "t1-ckpt"), D.host_addresses(pages))
    found = ST.read_results(spark, out)
    return ST.no_results(spark) if found is None else found


@register("t2_stream_cache_put")
def t2_stream_cache_put(spark, sf):
    pages = _pages(spark, sf)
    cache_path = _scratch(spark, "t2-cache")
    ST.stream_cache_put(ST.table_stream(spark, sf), cache_path, _scratch(spark, "t2-ckpt"), D.host_addresses(pages))
    return CA.read_cache(spark, cache_path).select("url_key", "url", "title", "n_bytes")


@register("h4_html_blocks", X.html_blocks_sql(_CONTENT_SQL))
def h4_html_blocks(spark, sf):
    return X.html_blocks(X.main_content(_pages(spark, sf)))


# The driver's articles are flat: every block is at the top, blocks close in the order they
# open, and inline elements only take numbers.
_ALL_TAGS = r"(?i)<(h[1-6]|p|b|br)\b[^>]*>"
_BLOCK_TAGS = r"(?i)<(?:h[1-6]|p)\b[^>]*>"
_FLAT_BLOCKS = f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, 0 AS parent, 1 AS depth, tag, CAST(row_number() OVER w AS INTEGER) AS post,
  CASE WHEN inner_text = '' THEN '' WHEN tag = 'p' THEN inner_text ELSE repeat('#', CAST(tag[2:] AS INTEGER)) || ' ' || inner_text END AS markdown
FROM (
  SELECT page_id, pos, tag, {H.html_text_sql("pieces[count(*) OVER (PARTITION BY page_id ORDER BY pos) + 1]")} AS inner_text
  FROM (SELECT page_id, lower(unnest(tags)) AS tag, generate_subscripts(tags, 1) AS pos, pieces
        FROM (SELECT page_id, regexp_extract_all(content_html, {sql_str(_ALL_TAGS)}, 1) AS tags, regexp_split_to_array(content_html, {sql_str(_BLOCK_TAGS)}) AS pieces
              FROM {_CONTENT_SQL}))
  WHERE tag NOT IN ('b', 'br'))
WINDOW w AS (PARTITION BY page_id ORDER BY pos)"""


@register("h4_block_tree", _FLAT_BLOCKS)
def h4_block_tree(spark, sf):
    return X.html_block_tree(X.main_content(_pages(spark, sf)))


# ---------------------------------------------------------------------------
# Oracle for the registered crawl (budget of 3 pages, all origins). With three pages a
# crawl is the seed, then the first two new links of the seed, or - when the seed has
# exactly one new link - that link and the first link of it not queued before. This
# closed form is written independently of the Spark level loop.
# ---------------------------------------------------------------------------

def _distinct_in_order(arr: str) -> str:
    return f"list_transform([{arr}], lambda a: list_filter(a, lambda x, i: list_position(a, x) = i))[1]"


def _links_sql(md: str, base: str) -> str:
    raw = f"({L.inline_link_array_sql(md)} || {L.bare_link_array_sql(md)})"
    resolved = f"list_filter(list_transform({raw}, lambda x: {U.resolve_url_sql('x', base)}), lambda t: t IS NOT NULL)"
    return _distinct_in_order(resolved)


def _crawl3_sql() -> str:
    assert CRAWL_MAX_PAGES == 3
    lp = D.linked_pages_sql()
    cols = "url, title, markdown, error, status"
    r = lambda req: RP.read_pages_sql(req, lp, dedupe=False)
    return f"""(WITH s0 AS (
  SELECT request_url AS seed, CAST(1 AS BIGINT) AS ord, 0 AS level, request_url, {cols}
  FROM ({r(f"(SELECT url, CAST(0 AS BIGINT) AS ord FROM {lp})")})),
f1 AS (SELECT seed, list_filter({_links_sql('markdown', 'request_url')}, lambda x: x <> seed) AS f1 FROM s0
  WHERE markdown <> '' AND status <> 'policy'),
l1 AS (SELECT seed, f1, unnest(f1[1:2]) AS request_url, CAST(generate_subscripts(f1[1:2], 1) + 1 AS BIGINT) AS ord FROM f1),
r1 AS ({r("(SELECT DISTINCT request_url AS url, CAST(0 AS BIGINT) AS ord FROM l1)")}),
s1 AS (SELECT l1.seed, l1.ord, 1 AS level, l1.request_url, r1.url, r1.title, r1.markdown, r1.error, r1.status, l1.f1
  FROM l1 JOIN r1 ON l1.request_url = r1.request_url),
l2 AS (SELECT seed, CAST(3 AS BIGINT) AS ord, list_filter({_links_sql('markdown', 'request_url')},
    lambda x: x <> seed AND NOT list_contains(f1, x))[1] AS request_url FROM s1
  WHERE len(f1) = 1 AND ord = 2 AND markdown <> '' AND status <> 'policy'),
r2 AS ({r("(SELECT DISTINCT request_url AS url, CAST(0 AS BIGINT) AS ord FROM l2 WHERE request_url IS NOT NULL)")}),
s2 AS (SELECT l2.seed, l2.ord, 2 AS level, l2.request_url, r2.url, r2.title, r2.markdown, r2.error, r2.status
  FROM l2 JOIN r2 ON l2.request_url = r2.request_url),
res AS (SELECT * FROM s0 UNION ALL SELECT * EXCLUDE (f1) FROM s1 UNION ALL SELECT * FROM s2),
ab AS (SELECT seed, arg_min(error, ord) AS seed_error FROM res WHERE status = 'policy' GROUP BY seed)
SELECT res.*, CAST(NULL AS VARCHAR) AS seed_error FROM res ANTI JOIN ab USING (seed)
UNION ALL SELECT seed, 1, 0, seed, seed, NULL, '', seed_error, 'policy', seed_error FROM ab)"""


_C1_SQL = _crawl3_sql()
ORACLE["c1_crawl_budget"] = f"SELECT * FROM {_C1_SQL}"
_WITH_C1 = f"WITH c1 AS MATERIALIZED (SELECT * FROM {_C1_SQL}) "

_COMBINE_SQL = f"""(SELECT seed, count(*) FILTER (WHERE seed_error IS NULL) AS n_pages,
  coalesce(string_agg(piece, chr(10) ORDER BY ord) FILTER (WHERE seed_error IS NULL), '') AS markdown FROM (
  SELECT seed, ord, seed_error, CASE WHEN error IS NOT NULL THEN '<!-- Error fetching ' || url || ': ' || error || ' -->'
    ELSE CASE WHEN n > 1 AND ord > 1 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END
      || '<!-- Source: ' || url || ' -->' || chr(10) || coalesce(markdown, '') END AS piece
  FROM (SELECT *, count(*) OVER (PARTITION BY seed) AS n FROM c1)) GROUP BY seed)"""
_ERRORS_SQL = f"""(SELECT seed, CASE WHEN max(seed_error) IS NOT NULL THEN max(seed_error) WHEN count(*) FILTER (WHERE error IS NOT NULL) > 0 THEN '{CB.ERRORS_PREFIX}' ||
  string_agg(url, ', ' ORDER BY ord) FILTER (WHERE error IS NOT NULL) END AS error FROM c1 GROUP BY seed)"""

ORACLE["m10_combine_pages"] = f"{_WITH_C1}SELECT seed, n_pages, markdown FROM {_COMBINE_SQL}"
ORACLE["m11_error_report"] = f"{_WITH_C1}SELECT seed, error FROM {_ERRORS_SQL}"
ORACLE["s10_export_markdown"] = f"{_WITH_C1}SELECT seed, markdown AS text FROM {_COMBINE_SQL}"
ORACLE["m12_read_summary"] = f"""{_WITH_C1}SELECT c.seed, f.title, array_to_string(coalesce(k.links, []), ' ') AS links, len(coalesce(k.links, [])) AS n_links,
  CASE WHEN e.error IS NOT NULL AND c.markdown <> '' THEN c.markdown || chr(10) || chr(10) || '---' || chr(10) || '*Note: ' || e.error || '*'
       WHEN e.error IS NOT NULL THEN NULL ELSE c.markdown END AS text,
  e.error, e.error IS NOT NULL AND c.markdown = '' AS failed
FROM {_COMBINE_SQL} c JOIN {_ERRORS_SQL} e USING (seed)
JOIN (SELECT seed, max(title) FILTER (WHERE ord = 1) AS title FROM c1 GROUP BY seed) f USING (seed)
LEFT JOIN (SELECT seed, flatten(list({_links_sql('markdown', 'request_url')} ORDER BY ord)) AS links FROM c1 WHERE status = 'ok' GROUP BY seed) k USING (seed)"""


# Oracle for the longer crawl: one row per seed and step, with the queue and what has been
# queued as lists, over the results and links of every URL that a page or a link names.
def _crawl_queue_sql(budget: int) -> str:
    lp = D.linked_pages_sql()
    r = lambda req: RP.read_pages_sql(req, lp, dedupe=False)
    links = _links_sql("markdown", "request_url")
    ok = "r.markdown <> '' AND r.status <> 'policy'"
    new = f"(CASE WHEN c.n + 1 < {budget} AND {ok} THEN list_filter(r.lk, lambda x: NOT list_contains(c.seen, x)) ELSE [] END)"
    return f"""WITH RECURSIVE pm AS MATERIALIZED ({r(f"(SELECT url, CAST(0 AS BIGINT) AS ord FROM {lp})")}),
names AS (SELECT url FROM {lp} UNION SELECT unnest({links}) FROM pm),
res AS MATERIALIZED (SELECT *, {links} AS lk FROM ({r("(SELECT url, CAST(0 AS BIGINT) AS ord FROM names)")})),
crawl(seed, n, queue, seen, cur) AS (
  SELECT url, 0, [url], [url], CAST(NULL AS VARCHAR) FROM {lp}
  UNION ALL
  SELECT c.seed, c.n + 1, c.queue[2:] || {new}, c.seen || {new}, c.queue[1]
  FROM crawl c LEFT JOIN res r ON r.request_url = c.queue[1] WHERE len(c.queue) > 0 AND c.n < {budget}),
got AS MATERIALIZED (SELECT c.seed, CAST(c.n AS BIGINT) AS ord, c.cur AS request_url, r.url, r.title, r.markdown, r.error, r.status
  FROM crawl c JOIN res r ON r.request_url = c.cur WHERE c.n > 0),
ab AS (SELECT seed, arg_min(error, ord) AS e FROM got WHERE status = 'policy' GROUP BY seed)
SELECT got.*, CAST(NULL AS VARCHAR) AS seed_error FROM got ANTI JOIN ab USING (seed)
UNION ALL SELECT seed, 1, seed, seed, NULL, '', e, 'policy', e FROM ab"""


ORACLE["c1_crawl_budget_long"] = _crawl_queue_sql(LONG_CRAWL)


# Oracle for the redirect chains: a recursive CTE over a precomputed step table.
def _redirects_sql(canonical: bool = False) -> str:
    """``canonical``: requests, hops and locations by canonical URL, the first request of each."""
    key = (lambda e: f"coalesce({U.normalize_url_sql(e)}, {e})") if canonical else (lambda e: e)
    hops = D.hops_sql()
    starts = "pages"
    if canonical:
        hops = (
            f"(SELECT url, r.status AS status, r.location AS location, r.content_type AS content_type FROM (SELECT url, min(struct_pack("
            f"status := status, location := location, content_type := content_type)) AS r FROM (SELECT {key('url')} AS url, status, location, content_type "
            f"FROM {hops}) GROUP BY url))"
        )
        starts = f"(SELECT {key('url')} AS url, min(page_id) AS page_id FROM pages GROUP BY ALL)"
    nodes = (
        f"(SELECT DISTINCT url FROM (SELECT url FROM {starts} UNION ALL SELECT url FROM {hops} UNION ALL "
        f"SELECT {key(U.resolve_url_sql('location', 'url', keep_absolute_raw=False))} FROM {hops} "
        f"WHERE status >= 300 AND status < 400 AND location IS NOT NULL AND location <> '') WHERE url IS NOT NULL)"
    )
    ha = f"(WITH {D.host_keys_cte()} SELECT * FROM {D.host_addresses_sql()})"
    judged = f"(SELECT url, reason AS policy FROM {P.url_policy_sql(nodes, ha)})"
    kind = (
        "CASE WHEN h.url IS NULL THEN NULL WHEN h.status >= 300 AND h.status < 400 AND (h.location IS NULL OR h.location = '') THEN 'error' "
        "WHEN h.status >= 300 AND h.status < 400 THEN 'redirect' WHEN NOT (h.status >= 200 AND h.status < 300) THEN 'error' "
        "WHEN h.content_type IS NOT NULL AND NOT contains(h.content_type, 'text/html') AND NOT contains(h.content_type, 'application/xhtml+xml') "
        "THEN 'error' ELSE 'ok' END"
    )
    herr = (
        "CASE WHEN h.status >= 300 AND h.status < 400 AND (h.location IS NULL OR h.location = '') THEN 'Redirect without Location header for ' || h.url "
        "WHEN h.status >= 300 AND h.status < 400 THEN NULL WHEN NOT (h.status >= 200 AND h.status < 300) THEN 'HTTP ' || CAST(h.status AS VARCHAR) || ' for ' || h.url "
        "WHEN h.content_type IS NOT NULL AND NOT contains(h.content_type, 'text/html') AND NOT contains(h.content_type, 'application/xhtml+xml') "
        "THEN 'Non-HTML content type: ' || h.content_type || ' for ' || h.url END"
    )
    step = (
        f"(SELECT j.url AS cur, CASE WHEN j.policy IS NOT NULL OR h.url IS NULL THEN 'error' ELSE {kind} END AS kind, "
        f"coalesce(j.policy, CASE WHEN h.url IS NULL THEN 'No capture for ' || j.url END, {herr}) AS error, "
        f"CASE WHEN {kind} = 'redirect' THEN {key(U.resolve_url_sql('h.location', 'h.url', keep_absolute_raw=False))} END AS nxt "
        f"FROM {judged} j LEFT JOIN {hops} h ON j.url = h.url)"
    )
    mx = CR.MAX_REDIRECTS
    return f"""WITH RECURSIVE st AS MATERIALIZED {step},
chain(ord, request_url, cur, n_hops, kind, error, nxt) AS (
  SELECT p.page_id, p.url, p.url, 0, s.kind, s.error, s.nxt FROM {starts} p LEFT JOIN st s ON s.cur = p.url
  UNION ALL
  SELECT c.ord, c.request_url, c.nxt, c.n_hops + 1, s.kind, s.error, s.nxt
  FROM chain c LEFT JOIN st s ON s.cur = c.nxt WHERE c.kind = 'redirect' AND c.n_hops < {mx + 1})
SELECT ord, request_url, CASE WHEN kind = 'ok' AND n_hops <= {mx} THEN cur END AS final_url, n_hops,
  CASE WHEN n_hops > {mx} THEN '{CR.TOO_MANY}' || request_url
       ELSE coalesce(error, CASE WHEN kind IS NULL THEN 'No capture for ' || cur END) END AS error
FROM chain WHERE (kind IS DISTINCT FROM 'redirect' OR n_hops > {mx}) AND n_hops <= {mx + 1}"""


ORACLE["s3_resolve_redirects"] = _redirects_sql()


# Oracle for the depth-1 crawl: seed, then its page's DOM links (canonical keys, first
# discovery, links before the first unsafe one), the seed turned into an error row
# when one of its new links fails the policy.
def _crawl_depth1_sql(same_origin: bool = False) -> str:
    """With ``links`` as a list; null for pages that weren't read."""
    lp = D.linked_pages_sql()
    key = lambda e: f"coalesce({U.normalize_url_sql(e)}, {e})"
    r = lambda req: RP.read_pages_sql(req, lp, dedupe=False)
    caps = (
        f"(SELECT * FROM (SELECT {key('url')} AS _ck, url AS _cu, html AS _ch, row_number() OVER (PARTITION BY {key('url')} "
        f"ORDER BY page_id) AS rn FROM {lp}) WHERE rn = 1)"
    )
    dom = (
        _distinct_in_order(
            f"list_filter(list_transform({L.href_array_sql('_ch')}, lambda h: {U.resolve_url_sql('h', '_cu', keep_absolute_raw=False)}), "
            f"lambda t: t IS NOT NULL AND regexp_matches(t, '^https?://'))"
        )
    )
    ha = f"(WITH {D.host_keys_cte()} SELECT * FROM {D.host_addresses_sql()})"
    same = f" AND {U.url_origin_sql('link')} = {U.url_origin_sql('page')}" if same_origin else ""
    return f"""(WITH seeds AS (SELECT url AS seed, {key('url')} AS request_url FROM {lp}),
r0 AS ({r("(SELECT DISTINCT request_url AS url, CAST(0 AS BIGINT) AS ord FROM seeds)")}),
l0 AS (SELECT s.seed, s.request_url, r0.url, r0.title, r0.markdown, r0.error, r0.status,
         CASE WHEN r0.status = 'ok' THEN {dom} END AS links
       FROM seeds s JOIN r0 ON r0.request_url = s.request_url LEFT JOIN {caps} c ON r0.status = 'ok' AND c._cu = r0.url),
e AS (SELECT seed, CAST(generate_subscripts(links, 1) - 1 AS BIGINT) AS pos, unnest(links) AS link, request_url AS seed_key, url AS page FROM l0),
e2 AS (SELECT seed, pos, {key('link')} AS request_url FROM e WHERE {key('link')} <> seed_key{same}),
pol AS (SELECT seed, pos, request_url, reason FROM {P.url_policy_sql("(SELECT seed, pos, request_url, request_url AS url FROM e2)", ha)}),
bad AS (SELECT seed, min(pos) AS bad_pos, arg_min(reason, pos) AS bad_reason FROM pol WHERE reason IS NOT NULL GROUP BY seed),
keep AS (SELECT p.seed, p.request_url, min(p.pos) AS pos FROM pol p LEFT JOIN bad b USING (seed)
         WHERE b.bad_pos IS NULL OR p.pos < b.bad_pos GROUP BY p.seed, p.request_url),
l1 AS (SELECT seed, request_url, CAST(1 + row_number() OVER (PARTITION BY seed ORDER BY pos) AS BIGINT) AS ord FROM keep),
r1 AS ({r("(SELECT DISTINCT request_url AS url, CAST(0 AS BIGINT) AS ord FROM l1)")}),
pg AS (SELECT l0.seed, CAST(1 AS BIGINT) AS ord, 0 AS level, l0.request_url,
  CASE WHEN b.bad_reason IS NOT NULL THEN l0.request_url ELSE l0.url END AS url,
  CASE WHEN b.bad_reason IS NULL THEN l0.title END AS title,
  CASE WHEN b.bad_reason IS NOT NULL THEN '' ELSE l0.markdown END AS markdown,
  coalesce(b.bad_reason, l0.error) AS error,
  CASE WHEN b.bad_reason IS NOT NULL THEN 'link_policy' ELSE l0.status END AS status
FROM l0 LEFT JOIN bad b USING (seed)
UNION ALL
SELECT l1.seed, l1.ord, 1 AS level, l1.request_url, r1.url, r1.title, r1.markdown, r1.error, r1.status
FROM l1 JOIN r1 ON r1.request_url = l1.request_url)
SELECT pg.*, CASE WHEN pg.status = 'ok' THEN {dom} END AS links FROM pg LEFT JOIN {caps} c ON pg.status = 'ok' AND c._cu = pg.url)"""


ORACLE["c2_crawl_depth"] = f"SELECT * REPLACE (array_to_string(links, ' ') AS links) FROM {_crawl_depth1_sql()}"


def _json_field(name: str, first: bool) -> str:
    sep = "" if first else ","
    return f"CASE WHEN {name} IS NOT NULL THEN '{sep}\"{name}\":' || CAST(to_json({name}) AS VARCHAR) ELSE '' END"


ORACLE["s9_export_json"] = (
    f"SELECT ord, '{{\"url\":' || CAST(to_json(url) AS VARCHAR) || {_json_field('markdown', False)} || "
    f"{_json_field('title', False)} || {_json_field('error', False)} || '}}' AS json FROM {_H8_SQL}"
)
_C2_SAME = _crawl_depth1_sql(same_origin=True)
ORACLE["s9_export_json_crawl"] = (
    f"SELECT seed, ord, '{{\"url\":' || CAST(to_json(url) AS VARCHAR) || {_json_field('markdown', False)} || "
    f"{_json_field('title', False)} || {_json_field('links', False)} || {_json_field('error', False)} || '}}' AS json FROM {_C2_SAME}"
)
ORACLE["s11_export_both_crawl"] = ORACLE["s11_export_both"].replace("SELECT ord,", "SELECT seed, ord,", 1).replace(_H8_SQL, _C2_SAME)

# H8 over responses: the chains of S3 first, then the page that each one ends at.
_END_SQL = RP.read_pages_sql("(SELECT final_url AS url, min(ord) AS ord FROM ends WHERE final_url IS NOT NULL GROUP BY final_url)", _RESPONSES_SQL)
_FIRST_SQL = f"(SELECT url_key, arg_min(url, page_id) AS url FROM (SELECT coalesce({U.normalize_url_sql('url')}, url) AS url_key, url, page_id FROM pages) GROUP BY url_key)"
ORACLE["h8_read_responses"] = f"""WITH ends AS MATERIALIZED (SELECT * FROM ({_redirects_sql(canonical=True)})),
pol AS (SELECT url_key, reason FROM {P.url_policy_sql('(SELECT url_key, url_key AS url FROM ' + _FIRST_SQL + ')', _HA_SQL)}),
got AS (SELECT * FROM ({_END_SQL}))
SELECT e.ord, f.url AS request_url, CASE WHEN e.final_url IS NULL THEN e.request_url ELSE g.url END AS url,
  g.title, coalesce(g.markdown, '') AS markdown, coalesce(e.error, g.error) AS error,
  CASE WHEN pol.reason IS NOT NULL THEN 'policy' WHEN e.final_url IS NULL THEN 'fetch' ELSE g.status END AS status
FROM ends e JOIN {_FIRST_SQL} f ON f.url_key = e.request_url JOIN pol ON pol.url_key = e.request_url LEFT JOIN got g ON g.request_url = e.final_url"""
ORACLE["h8_read_cached_robots"] = f"""WITH h8 AS MATERIALIZED {_H8_SQL},
rb AS (SELECT page_id, robots_allowed FROM {CR.robots_filter_sql('(SELECT page_id, url FROM pages)', _ROBOTS_SQL, D.ROBOTS_AGENT)}),
j AS (SELECT h.*, h.status <> 'policy' AND h.error IS NULL AND h.ord % 3 = 0 AS hit, NOT rb.robots_allowed AS blocked,
        coalesce({U.normalize_url_sql('request_url')}, request_url) AS url_key FROM h8 h JOIN rb ON rb.page_id = h.ord)
SELECT ord, request_url, CASE WHEN status = 'policy' THEN url WHEN hit OR blocked THEN url_key ELSE url END AS url,
  CASE WHEN hit THEN title WHEN status <> 'policy' AND blocked THEN NULL ELSE title END AS title,
  CASE WHEN hit THEN 'cached: ' || markdown WHEN status <> 'policy' AND blocked THEN '' ELSE markdown END AS markdown,
  CASE WHEN hit THEN NULL WHEN status <> 'policy' AND blocked THEN '{RP.ROBOTS_ERROR}' ELSE error END AS error,
  CASE WHEN hit THEN 'cached' WHEN status <> 'policy' AND blocked THEN 'robots' ELSE status END AS status
FROM j"""
_T1_SQL = (
    f"SELECT coalesce({U.normalize_url_sql('request_url')}, request_url) AS url_key, ord AS page_id, url, title, markdown, error, status "
    f"FROM ({RP.read_pages_table_sql()})"
)
ORACLE["t1_stream_read_pages"] = _T1_SQL
ORACLE["t2_stream_cache_put"] = ORACLE["s5_cache_entries"]

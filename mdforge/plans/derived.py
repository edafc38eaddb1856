"""Inputs derived by Spark from the driver's tables (with DuckDB twins for the oracle).

The driver's ``pages`` carry no address table, no Markdown with links and no link
graph between captured pages. These derivations build them from ``pages`` by fixed
formulas, so every registered query still reads the given tables and its work grows
with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.regex import Rx, let, rx_spark, rx_sql, sql_str

# ---------------------------------------------------------------------------
# host_addresses(host, address, family, pos): a deterministic "DNS" for page hosts.
# ---------------------------------------------------------------------------

def _v4_formula(k, hl):
    return F.concat_ws(
        ".",
        ((k * 37 + 11) % 256).cast("string"),
        ((k * 101) % 256).cast("string"),
        ((hl * 13) % 256).cast("string"),
        (k % 256).cast("string"),
    )


V6_PREFIX = (0x2606, 0xFE80, 0x2001, 0xFC00)


def host_addresses(pages: DataFrame) -> DataFrame:
    hosts = (
        pages.select(U.url_part(F.col("url"), "host").alias("host"), "page_id")
        .filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.min("page_id").alias("k"))
    )
    k, hl = F.col("k"), F.length(F.col("host"))
    v4 = _v4_formula(k, hl)
    prefix = F.element_at(F.array(*[F.lit(p) for p in V6_PREFIX]), (k % 4 + 1).cast("int"))
    v6 = F.format_string("%x:%x::%x", prefix, k % 65536, hl.cast("bigint"))
    rows = F.array(
        F.struct(v4.alias("address"), F.lit(4).alias("family"), F.lit(0).alias("pos")),
        F.struct(F.when(k % 3 == 0, v6).alias("address"), F.lit(6).alias("family"), F.lit(1).alias("pos")),
        F.struct(F.when(k % 10 == 7, F.concat(F.lit("::ffff:"), v4)).alias("address"), F.lit(6).alias("family"), F.lit(2).alias("pos")),
    )
    return (
        hosts.select("host", F.explode(rows).alias("r"))
        .select("host", "r.address", "r.family", "r.pos")
        .filter(F.col("address").isNotNull())
    )


def host_addresses_sql() -> str:
    v4 = "CAST((k * 37 + 11) % 256 AS VARCHAR) || '.' || CAST((k * 101) % 256 AS VARCHAR) || '.' || CAST((length(host) * 13) % 256 AS VARCHAR) || '.' || CAST(k % 256 AS VARCHAR)"
    prefix = f"([{', '.join(str(p) for p in V6_PREFIX)}])[k % 4 + 1]"
    v6 = f"printf('%x:%x::%x', {prefix}, k % 65536, length(host))"
    return f"""(SELECT host, address, family, pos FROM (
  SELECT host, {v4} AS address, 4 AS family, 0 AS pos FROM hk
  UNION ALL SELECT host, {v6}, 6, 1 FROM hk WHERE k % 3 = 0
  UNION ALL SELECT host, '::ffff:' || {v4}, 6, 2 FROM hk WHERE k % 10 = 7))"""


def host_keys_cte() -> str:
    return (
        f"hk AS (SELECT host, min(page_id) AS k FROM (SELECT {U.url_part_sql('url', 'host')} AS host, page_id FROM pages) "
        f"WHERE host IS NOT NULL GROUP BY host)"
    )


# ---------------------------------------------------------------------------
# Markdown with links: the whole page body (navigation included) after a source
# comment, the way a combined document carries each page.
# ---------------------------------------------------------------------------
MIN_CLEAN = H.CLEAN_STEPS[:6]
BODY_RE = H.CONTAINERS[2]


def link_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, url, md) of (page_id, url, html)."""
    def body(cleaned):
        return let(F.regexp_extract(cleaned, BODY_RE, 1), lambda b: F.when(b != "", b).otherwise(cleaned))

    bodies = pages.select("page_id", "url", let(rx_spark(F.col("html"), MIN_CLEAN), body).alias("_body"))
    return bodies.select("page_id", "url", F.concat(F.lit("<!-- Source: "), F.col("url"), F.lit(" -->\n"), H.html_to_markdown("_body")).alias("md"))


def link_markdown_sql(html: str, url: str) -> str:
    cleaned = rx_sql(html, MIN_CLEAN)
    return (
        f"list_transform([{cleaned}], lambda cl: '<!-- Source: ' || {url} || ' -->\n' || "
        f"{H.html_to_markdown_sql(f'coalesce(nullif(regexp_extract(cl, {sql_str(BODY_RE)}, 1), ' + chr(39) * 2 + '), cl)')})[1]"
    )


# ---------------------------------------------------------------------------
# Duplicate URL set for U3: each page URL plus two spellings of the same key.
# ---------------------------------------------------------------------------
PORT_STEPS_HTTP = (Rx(r"^(http://[^/?#:]+)", "{1}:80"),)
PORT_STEPS_HTTPS = (Rx(r"^(https://[^/?#:]+)", "{1}:443"),)


def url_variants(pages: DataFrame) -> DataFrame:
    base = pages.select("page_id", "url")
    frag = F.concat(F.regexp_replace(F.col("url"), "#.*", ""), F.lit("#v"))
    port = rx_spark(rx_spark(F.col("url"), PORT_STEPS_HTTP), PORT_STEPS_HTTPS)
    return base.select(
        "page_id",
        F.explode(
            F.array(
                F.struct(F.col("url").alias("url"), (F.col("page_id") * 3).alias("ord")),
                F.struct(frag.alias("url"), (F.col("page_id") * 3 + 1).alias("ord")),
                F.struct(port.alias("url"), (F.col("page_id") * 3 + 2).alias("ord")),
            )
        ).alias("v"),
    ).select("page_id", "v.url", "v.ord")


def url_variants_sql() -> str:
    port = rx_sql(rx_sql("url", PORT_STEPS_HTTP), PORT_STEPS_HTTPS)
    return f"""(SELECT page_id, url, page_id * 3 AS ord FROM pages
  UNION ALL SELECT page_id, regexp_replace(url, '#.*', '') || '#v', page_id * 3 + 1 FROM pages
  UNION ALL SELECT page_id, {port}, page_id * 3 + 2 FROM pages)"""


# ---------------------------------------------------------------------------
# Linked pages: each article gains a paragraph of links to pages p+1, p+2, 2p+1 (when
# captured), so crawls over the captured pages have somewhere to go.
# ---------------------------------------------------------------------------

def linked_pages(pages: DataFrame) -> DataFrame:
    p = pages.select("page_id", "url", "html")
    targets = p.select(
        F.col("page_id").alias("src"),
        F.posexplode(F.array(F.col("page_id") + 1, F.col("page_id") + 2, F.col("page_id") * 2 + 1)).alias("pos", "dst"),
    )
    dst = p.select(F.col("page_id").alias("dst"), F.col("url").alias("dst_url"))
    anchors = (
        targets.join(dst, "dst")
        .groupBy("src")  # at most three rows per page
        .agg(F.array_sort(F.collect_list(F.struct("pos", "dst_url"))).alias("_a"))
        .select(
            "src",
            F.array_join(F.transform("_a", lambda s: F.concat(F.lit('<a href="'), s["dst_url"], F.lit('">related</a>'))), " ").alias("anchors"),
        )
    )
    j = p.join(anchors, p["page_id"] == anchors["src"], "left")
    close = "</article>"
    has = F.col("anchors").isNotNull() & F.col("html").contains(close)
    html = F.when(
        has,
        F.concat(
            F.substring_index("html", close, 1), F.lit("<p>"), F.col("anchors"), F.lit("</p>" + close),
            F.substring_index("html", close, -1),
        ),
    ).otherwise(F.col("html"))
    return j.select("page_id", "url", html.alias("html"))


def linked_pages_sql() -> str:
    anchors = (
        "(SELECT src, string_agg('<a href=\"' || dst_url || '\">related</a>', ' ' ORDER BY pos) AS anchors FROM "
        "(SELECT t.src, t.pos, d.url AS dst_url FROM (SELECT page_id AS src, unnest([page_id + 1, page_id + 2, page_id * 2 + 1]) AS dst, "
        "unnest([0, 1, 2]) AS pos FROM pages) t JOIN pages d ON d.page_id = t.dst) GROUP BY src)"
    )
    return (
        f"(SELECT p.page_id, p.url, CASE WHEN a.anchors IS NOT NULL AND contains(p.html, '</article>') THEN "
        f"split_part(p.html, '</article>', 1) || '<p>' || a.anchors || '</p></article>' || split_part(p.html, '</article>', -1) "
        f"ELSE p.html END AS html FROM pages p LEFT JOIN {anchors} a ON p.page_id = a.src)"
    )


# ---------------------------------------------------------------------------
# robots_rules(host, agent, directive, value) by formula on each host's first page.
# ---------------------------------------------------------------------------
ROBOTS_AGENT = "mdforge"


def robots_rules(pages: DataFrame) -> DataFrame:
    hosts = (
        pages.select(U.url_part(F.col("url"), "host").alias("host"), "page_id")
        .filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.min("page_id").alias("k"))
    )
    m = F.col("k") % 4

    def r(cond, agent, directive, value):
        return F.when(cond, F.struct(F.lit(agent).alias("agent"), F.lit(directive).alias("directive"), F.lit(value).alias("value")))

    rows = F.array(
        r(m == 0, "*", "disallow", "/en/"),
        r(m == 0, "*", "allow", "/en/1"),
        r(m == 1, "*", "disallow", "/fr/"),
        r(m == 1, ROBOTS_AGENT, "disallow", "/"),
        r(m == 2, "*", "crawl-delay", "2"),
        r(m == 2, "*", "disallow", "/*?utm_source="),
    )
    return hosts.select("host", F.explode(rows).alias("r")).filter(F.col("r").isNotNull()).select("host", "r.*")


def robots_rules_sql() -> str:
    rows = [
        (0, "*", "disallow", "/en/"), (0, "*", "allow", "/en/1"), (1, "*", "disallow", "/fr/"),
        (1, ROBOTS_AGENT, "disallow", "/"), (2, "*", "crawl-delay", "2"), (2, "*", "disallow", "/*?utm_source="),
    ]
    vals = ", ".join(f"({m}, {sql_str(a)}, {sql_str(d)}, {sql_str(v)})" for m, a, d, v in rows)
    return (
        f"(SELECT hk.host, r.agent, r.directive, r.value FROM hk JOIN (VALUES {vals}) r(m, agent, directive, value) "
        f"ON hk.k % 4 = r.m)"
    )


# ---------------------------------------------------------------------------
# hops(url, status, location, content_type): one HTTP response per URL, by formula.
# ---------------------------------------------------------------------------
HTML_TYPE = "text/html; charset=utf-8"


def hops(pages: DataFrame) -> DataFrame:
    p = pages.select("page_id", "url", U.url_origin(F.col("url")).alias("origin"))
    pid = F.col("page_id")
    chain_len = (F.floor(pid / 7) % 7 + 1).cast("int")
    none = F.lit(None).cast("string")

    def h(status, location, ctype):
        return F.struct(F.lit(status).alias("status"), location.alias("location"), ctype.alias("content_type"))

    first = (
        F.when(pid % 7 == 3, h(301, F.concat(F.lit("/r/1/"), pid.cast("string")), none))
        .when(pid % 11 == 5, h(302, F.lit("http://127.0.0.1/metadata"), none))
        .when(pid % 13 == 6, h(404, none, F.lit(HTML_TYPE)))
        .when(pid % 17 == 8, h(200, none, F.lit("application/pdf")))
        .when(pid % 19 == 9, h(302, none, none))
        .otherwise(h(200, none, F.lit(HTML_TYPE)))
    )
    base = p.select("url", first.alias("h")).select("url", "h.*")
    chain = (
        p.filter((pid % 7 == 3) & F.col("origin").isNotNull())
        .select("page_id", "origin", F.explode(F.sequence(F.lit(1), chain_len)).alias("i"), chain_len.alias("n"))
        .select(
            F.concat(F.col("origin"), F.lit("/r/"), F.col("i").cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("url"),
            F.when(F.col("i") < F.col("n"), F.lit(302)).otherwise(F.lit(200)).alias("status"),
            F.when(F.col("i") < F.col("n"), F.concat(F.lit("/r/"), (F.col("i") + 1).cast("string"), F.lit("/"), F.col("page_id").cast("string"))).alias("location"),
            F.when(F.col("i") >= F.col("n"), F.lit(HTML_TYPE)).alias("content_type"),
        )
    )
    return base.unionByName(chain)


def hops_sql() -> str:
    return f"""(SELECT url,
  CASE WHEN page_id % 7 = 3 THEN 301 WHEN page_id % 11 = 5 THEN 302 WHEN page_id % 13 = 6 THEN 404 WHEN page_id % 17 = 8 THEN 200
       WHEN page_id % 19 = 9 THEN 302 ELSE 200 END AS status,
  CASE WHEN page_id % 7 = 3 THEN '/r/1/' || CAST(page_id AS VARCHAR) WHEN page_id % 11 = 5 THEN 'http://127.0.0.1/metadata' END AS location,
  CASE WHEN page_id % 7 = 3 THEN NULL WHEN page_id % 11 = 5 THEN NULL WHEN page_id % 13 = 6 THEN '{HTML_TYPE}'
       WHEN page_id % 17 = 8 THEN 'application/pdf' WHEN page_id % 19 = 9 THEN NULL ELSE '{HTML_TYPE}' END AS content_type
FROM pages
UNION ALL
SELECT origin || '/r/' || CAST(i AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) AS url, CASE WHEN i < n THEN 302 ELSE 200 END,
  CASE WHEN i < n THEN '/r/' || CAST(i + 1 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) END, CASE WHEN i >= n THEN '{HTML_TYPE}' END
FROM (SELECT page_id, origin, n, unnest(range(1, n + 1)) AS i FROM (SELECT page_id, {U.url_origin_sql('url')} AS origin,
  CAST(floor(page_id / 7) % 7 + 1 AS INTEGER) AS n FROM pages WHERE page_id % 7 = 3)) WHERE origin IS NOT NULL)"""

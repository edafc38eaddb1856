"""H8 flagship: requested URLs + captured pages -> one result row per page.

Order of the reference pipeline, re-expressed as relational steps:
U2/U3 canonical key and dedupe -> U6 policy -> S6 cache lookup -> C3 robots ->
S3 redirects + S2 response checks -> S4 capture lookup -> H6 blank test -> H2 article
-> H7 limited pages -> H3 Markdown. Failures stay as rows with ``error`` set.

The request side is settled first, as URL-sized rows: what is refused, cached, blocked or
redirected away never costs an extraction. Captures are reduced to the live keys on
their URL and id columns, the first capture of a key is chosen there, and only the chosen
rows' HTML is extracted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import urlstandard as S
from ..operators import extract as X
from ..operators import policy as P
from ..operators import urls as UO
from ..session import settle
from ..sources.captures import table
from . import derived as D

RESULT_COLS = ("ord", "request_url", "url", "title", "markdown", "error", "status")
RESPONSE_COLS = ("status", "location", "content_type")
ROBOTS_ERROR = "Blocked by robots.txt"
NO_CAPTURE = "No capture for "


def canonical(url):
    """Canonical key of a URL; a URL that has none stands for itself."""
    return F.coalesce(U.normalize_url(url), url)


def first_captures(captures: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(_cap_key, _cap_ord, url): the first capture (by ``page_id``) of every canonical
    URL, of the live ``keys(_key)`` only if given. Reads URL and id columns."""
    order = F.col("page_id") if "page_id" in captures.columns else F.lit(0).cast("long")
    narrow = captures.select(canonical(F.col("url")).alias("_cap_key"), order.alias("_cap_ord"), "url")
    if keys is not None:
        narrow = narrow.join(keys, F.col("_cap_key") == F.col("_key"), "left_semi")
    return narrow.groupBy("_cap_key").agg(F.min(F.struct("_cap_ord", "url")).alias("_c")).select("_cap_key", "_c.*")


def prepare_captures(captures: DataFrame, keys: DataFrame | None = None, with_links: bool = False) -> DataFrame:
    """Extract the first capture of every canonical URL (of the live ``keys`` if given).

    Output: ``_cap_key, final_url, gate_status, gate_title, gate_markdown, gate_error``
    (+ ``links`` of the page DOM). Response columns of the captures play no part here.
    """
    order = F.col("page_id") if "page_id" in captures.columns else F.lit(0).cast("long")
    chosen = first_captures(captures, keys).withColumnsRenamed({"url": "_url", "_cap_ord": "_ord"})
    rows = captures.select("url", "html", order.alias("_cap_ord"))
    rows = rows.join(chosen, (F.col("url") == F.col("_url")) & (F.col("_cap_ord") == F.col("_ord")))
    gated = X.content_gate(rows.select("_cap_key", "url", "html"), html="html", url="url")
    from ..operators.links import dom_link_array

    return gated.select(
        "_cap_key",
        F.col("url").alias("final_url"),
        F.col("status").alias("gate_status"),
        F.col("title").alias("gate_title"),
        F.col("markdown").alias("gate_markdown"),
        F.col("error").alias("gate_error"),
        *([F.when(F.col("status") == "ok", dom_link_array(F.col("html"), F.col("url"))).alias("links")] if with_links else []),
    )


def response_hops(captures: DataFrame) -> DataFrame | None:
    """The captures' responses as hops, if they carry a ``status`` column."""
    if "status" not in captures.columns:
        return None
    none = F.lit(None).cast("string")
    return captures.select("url", "status", *[F.col(c) if c in captures.columns else none.alias(c) for c in RESPONSE_COLS[1:]])


def decide(
    requests: DataFrame,
    host_addresses: DataFrame,
    cache: DataFrame | None = None,
    robots_rules: DataFrame | None = None,
    user_agent: str = "*",
    hops: DataFrame | None = None,
    dedupe: bool = True,
    host_verdicts: DataFrame | None = None,
    chains: DataFrame | None = None,
) -> DataFrame:
    """What becomes of each request before any page is read, as narrow rows:
    ``(ord, request_url, url_key, decision, decision_error, lookup_key)``.

    ``decision``: policy, cached, robots, fetch (a failed redirect chain or response), or
    null: the capture of ``lookup_key`` is to be read. Redirects are followed in ``hops``, or
    in their ``chains`` (a ``redirect_table``) where the caller has them already.
    """
    req = requests.select(F.col("url").alias("request_url"), "ord").withColumn("_std", S.standard_column("request_url"))
    req = req.withColumn("url_key", canonical(F.col("_std"))).drop("_std")
    # With ``dedupe=False`` every request row is processed (callers pass distinct
    # request URLs, e.g. a crawl level where "/a" and "/a#x" are separate visits).
    uniq = UO.dedupe_urls(req, key="url_key", order="ord") if dedupe else req
    df = P.url_policy(uniq.withColumn("url", F.col("url_key")), host_addresses, url="url", host_verdicts=host_verdicts)
    df = df.select("ord", "request_url", "url_key", F.when(~F.col("allowed"), F.lit("policy")).alias("decision"), F.col("reason").alias("decision_error"))
    live = F.col("decision").isNull()
    if cache is not None:
        entries = cache.filter(F.col("markdown").isNotNull()).select(F.col("url_key").alias("_ck"))
        df = df.withColumn("_ckey", F.sha2(F.col("url_key"), 256)).join(entries, live & (F.col("_ckey") == F.col("_ck")), "left")
        df = df.withColumn("decision", F.when(F.col("_ck").isNotNull(), F.lit("cached")).otherwise(F.col("decision"))).drop("_ck", "_ckey")
    if robots_rules is not None:
        from ..operators.crawl import robots_filter

        df = robots_filter(df, robots_rules, user_agent=user_agent, url="url_key", only_where=live)
        blocked = live & ~F.coalesce(F.col("robots_allowed"), F.lit(True))
        df = df.withColumn("decision_error", F.when(blocked, F.lit(ROBOTS_ERROR)).otherwise(F.col("decision_error")))
        df = df.withColumn("decision", F.when(blocked, F.lit("robots")).otherwise(F.col("decision")))
    if hops is None and chains is None:
        return df.select("ord", "request_url", "url_key", "decision", "decision_error", F.when(live, F.col("url_key")).alias("lookup_key"))
    if chains is None:
        from ..operators.crawl import redirect_table

        chains = redirect_table(hops.withColumn("url", canonical(F.col("url"))), host_addresses, key=canonical, host_verdicts=host_verdicts)
    df = settle(df.select("ord", "request_url", "url_key", "decision", "decision_error"), "decided")
    # A live URL without a response has passed the policy; it only has no capture.
    ends = chains.select(F.col("start").alias("_start"), "final_url", F.col("error").alias("_error"))
    df = df.join(ends, live & (F.col("url_key") == F.col("_start")), "left")
    df = df.withColumn("_chain_error", F.when(F.col("_start").isNull(), F.concat(F.lit(NO_CAPTURE), F.col("url_key"))).otherwise(F.col("_error")))
    failed = live & F.col("_chain_error").isNotNull()
    return df.select(
        "ord", "request_url", "url_key",
        F.when(failed, F.lit("fetch")).otherwise(F.col("decision")).alias("decision"),
        F.when(failed, F.col("_chain_error")).otherwise(F.col("decision_error")).alias("decision_error"),
        F.when(live & ~failed, F.col("final_url")).alias("lookup_key"),
    )


def outcomes(decided: DataFrame, pages: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Decisions joined to extracted ``pages``: ``(ord, request_url, url_key, url, title,
    error, status)`` and the ``extra`` columns of pages that were read (null elsewhere).

    ``url`` is the canonical request URL for early failures and cache hits, else the
    captured URL."""
    df = decided.join(pages, F.col("lookup_key") == F.col("_cap_key"), "left")
    missing = F.col("decision").isNull() & F.col("_cap_key").isNull()
    status = F.coalesce(F.col("decision"), F.when(missing, F.lit("fetch")), F.col("gate_status"))
    read = F.col("decision").isNull() & ~missing
    return df.select(
        "ord", "request_url", "url_key",
        F.when(read, F.col("final_url")).otherwise(F.col("url_key")).alias("url"),
        F.when(read, F.col("gate_title")).alias("title"),
        F.when(read, F.col("gate_error")).when(missing, F.concat(F.lit(NO_CAPTURE), F.col("lookup_key"))).otherwise(F.col("decision_error")).alias("error"),
        status.alias("status"),
        *[F.when(read, F.col(c)).alias(c) for c in extra],
    )


def with_cached(results: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Title and Markdown of cache hits; failed requests have an empty Markdown."""
    if cache is None:
        return results.withColumn("markdown", F.coalesce("markdown", F.lit("")))
    entries = cache.select(F.col("url_key").alias("_ck"), F.col("title").alias("_cached_title"), F.col("markdown").alias("_cached_md"))
    hit = F.col("status") == "cached"
    out = results.join(entries, hit & (F.sha2(F.col("url_key"), 256) == F.col("_ck")), "left")
    out = out.withColumn("title", F.when(hit, F.col("_cached_title")).otherwise(F.col("title")))
    out = out.withColumn("markdown", F.coalesce(F.when(hit, F.col("_cached_md")).otherwise(F.col("markdown")), F.lit("")))
    return out.drop("_ck", "_cached_title", "_cached_md")


def read_pages(
    requests: DataFrame,
    captures: DataFrame,
    host_addresses: DataFrame,
    cache: DataFrame | None = None,
    robots_rules: DataFrame | None = None,
    user_agent: str = "*",
    with_links: bool = False,
    dedupe: bool = True,
    host_verdicts: DataFrame | None = None,
    hops: DataFrame | None = None,
) -> DataFrame:
    """``requests(url, ord)``; ``captures(url, html[, page_id, status, location,
    content_type])`` or the output of ``prepare_captures``; ``hops(url, status, location,
    content_type)``: responses to follow, by default those of the captures.

    Returns ``(ord, request_url, url, title, markdown, error, status)`` (+ ``links`` of
    the page DOM when ``with_links``).
    """
    prepared = "_cap_key" in captures.columns
    if hops is None and not prepared:
        hops = response_hops(captures)
    decided = settle(decide(requests, host_addresses, cache, robots_rules, user_agent, hops, dedupe, host_verdicts), "decided")
    if prepared:
        pages = captures
    else:
        keys = decided.filter(F.col("lookup_key").isNotNull()).select(F.col("lookup_key").alias("_key")).distinct()
        pages = prepare_captures(captures, keys, with_links)
    out = outcomes(decided, pages, ("gate_markdown", *(["links"] if with_links else [])))
    out = with_cached(out.withColumnRenamed("gate_markdown", "markdown"), cache)
    return out.select(*RESULT_COLS, *(["links"] if with_links else []))


def read_pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship over the driver tables: every page URL requested, pages as captures."""
    pages = table(spark, sf_dir, "pages")
    requests = pages.select("url", F.col("page_id").alias("ord"))
    return read_pages(requests, pages, D.host_addresses(pages))


def read_pages_table_sql() -> str:
    """DuckDB twin of ``read_pages_table`` (no cache, no robots)."""
    return read_pages_sql("(SELECT url, page_id AS ord FROM pages)", "pages", dedupe=True)


def read_pages_sql(requests: str, captures: str, dedupe: bool = True) -> str:
    """DuckDB twin of ``read_pages`` without cache/robots: ``requests(url, ord)``,
    ``captures(page_id, url, html)``; host addresses derived from ``pages``."""
    from ..functions import html as H
    from ..operators.extract import (
        EMPTY_RESPONSE, LIMITED_ERROR, MIN_CONTENT_CHARS, NO_ARTICLE,
    )

    key = f"coalesce({U.normalize_url_sql('url')}, url)"
    keyed = f"(SELECT url AS request_url, ord, {key} AS url_key FROM {requests})"
    if dedupe:
        uniq = (
            f"(SELECT request_url, ord, url_key, url_key AS url FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY ord) AS rn "
            f"FROM {keyed}) WHERE rn = 1)"
        )
    else:
        uniq = f"(SELECT request_url, ord, url_key, url_key AS url FROM {keyed})"
    ha = f"(WITH {D.host_keys_cte()} SELECT * FROM {D.host_addresses_sql()})"
    checked = P.url_policy_sql(uniq, ha)
    cap = (
        f"(SELECT * FROM (SELECT {key} AS _cap_key, url AS final_url, html, row_number() OVER (PARTITION BY {key} ORDER BY page_id) AS rn "
        f"FROM {captures}) WHERE rn = 1)"
    )
    joined = (
        f"SELECT c.ord, c.request_url, c.url_key, c.reason, c.reason IS NULL AS allowed, p._cap_key, p.final_url, p.html, "
        f"{H.main_content_sql('p.html')} AS content_html FROM {checked} c LEFT JOIN {cap} p ON c.reason IS NULL AND c.url_key = p._cap_key"
    )
    gate = (
        f"SELECT *, CASE WHEN NOT allowed THEN 'policy' WHEN _cap_key IS NULL THEN 'fetch' "
        f"WHEN html IS NULL OR {H.trim_ws_sql('html')} = '' THEN 'empty' WHEN content_html IS NULL THEN 'no_article' "
        f"WHEN length({H.trim_ws_sql('content_html')}) < {MIN_CONTENT_CHARS} THEN 'limited' ELSE 'ok' END AS status, "
        f"{H.page_title_sql('html')} AS t, {H.html_text_sql('content_html')} AS text FROM ({joined})"
    )
    from .catalog import _LIMITED_SQL

    limited = _LIMITED_SQL.replace("coalesce(nullif(title, ''),", "coalesce(nullif(t, ''),")
    return f"""SELECT ord, request_url,
  CASE WHEN status IN ('policy', 'fetch') THEN url_key ELSE final_url END AS url,
  CASE WHEN status = 'ok' THEN t WHEN status = 'limited' THEN coalesce(nullif(t, ''), final_url) END AS title,
  CASE WHEN status = 'ok' THEN {H.html_to_markdown_sql('content_html')} WHEN status = 'limited' THEN {limited} ELSE '' END AS markdown,
  CASE status WHEN 'policy' THEN reason WHEN 'fetch' THEN '{NO_CAPTURE}' || url_key WHEN 'empty' THEN '{EMPTY_RESPONSE}'
    WHEN 'no_article' THEN '{NO_ARTICLE}' WHEN 'limited' THEN '{LIMITED_ERROR}' END AS error,
  status
FROM ({gate})"""

"""M1-M4 and H5: links of Markdown and of page HTML, resolved, deduplicated, as edges.

Each page's link list is built as one array expression (extract, filter, resolve,
``array_distinct`` - which keeps first occurrences in order) and only then exploded,
so resolution runs once per link and no shuffle is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.regex import Rx, let, rx_spark, rx_sql, sql_str, trim_ws, trim_ws_sql

# The Markdown link patterns and the skipped inline prefixes.
INLINE_RE = r"\[([^\]]+)\]\(([^)]+)\)"
BARE_RE = r"https?://[^ \t\n\r\f\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}<>)\]]+"
SKIP_PREFIXES = ("#", "mailto:", "tel:")
# The value is quoted either way or bare.
HREF_RE = rf"""(?is){H.ANCHOR}("[^"]*"|'[^']*'|[^ \t\r\n\f"'>]+)"""
# What holds no anchor of the page: comments, scripts and styles.
HIDDEN_STEPS = H.CLEAN_STEPS[:3]
QUOTES = (Rx(r"""^["']|["']\z""", ""),)


def href_array(html: Column) -> Column:
    """Values of all anchors' href, in page order, references decoded and trimmed."""
    raw = F.regexp_extract_all(rx_spark(html, HIDDEN_STEPS), F.lit(HREF_RE), 1)
    return F.transform(raw, lambda v: trim_ws(H.decode_entities(rx_spark(v, QUOTES))))


def href_array_sql(html: str) -> str:
    raw = f"regexp_extract_all({rx_sql(html, HIDDEN_STEPS)}, {sql_str(HREF_RE)}, 1)"
    return f"list_transform({raw}, lambda v: {trim_ws_sql(H.decode_entities_sql(rx_sql('v', QUOTES)))})"


def _keep_inline(t: Column) -> Column:
    cond = F.lit(True)
    for p in SKIP_PREFIXES:
        cond = cond & ~t.startswith(p)
    return cond


def inline_link_array(md: Column) -> Column:
    """M1 as an array: inline targets with non-empty text, skipped prefixes removed."""
    return F.filter(F.regexp_extract_all(md, F.lit(INLINE_RE), 2), _keep_inline)


def bare_link_array(md: Column) -> Column:
    """M2 as an array: bare http(s) runs (also inside inline links)."""
    return F.regexp_extract_all(md, F.lit(BARE_RE), 0)


def page_link_array(md: Column, base: Column) -> Column:
    """M3 as an array: inline then bare, resolved against ``base``, first occurrence kept."""
    raw = F.concat(inline_link_array(md), bare_link_array(md))
    return let(base, lambda b: F.array_distinct(F.filter(F.transform(raw, lambda x: U.resolve_url(x, b)), lambda t: t.isNotNull())))


def _explode(df: DataFrame, keep: list[str], arr: Column, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode(arr).alias("pos", name)).withColumn("pos", (F.col("pos") + 1).cast("int"))


def inline_links(df: DataFrame, md: str = "markdown", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return _explode(df, list(keep), inline_link_array(F.col(md)), "raw")


def bare_links(df: DataFrame, md: str = "markdown", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return _explode(df, list(keep), bare_link_array(F.col(md)), "raw")


def page_links(df: DataFrame, md: str = "markdown", base: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """M3: (keep..., pos, link)."""
    return _explode(df, list(keep), page_link_array(F.col(md), F.col(base)), "link")


def link_edges(df: DataFrame, md: str = "markdown", base: str = "url", keep: tuple[str, ...] = ("page_id",),
               same_origin_only: bool = True) -> DataFrame:
    """M4: (keep..., src, pos, dst), same-origin against ``base`` by default."""
    def pick(b: Column) -> Column:
        links = page_link_array(F.col(md), b)
        if not same_origin_only:
            return links
        return let(U.url_origin(b), lambda bo: F.filter(links, lambda t: U.url_origin(t) == bo))

    out = _explode(df, [*keep, F.col(base).alias("src")], let(F.col(base), pick), "dst")
    return out


def dom_link_array(html: Column, base: Column) -> Column:
    """H5: anchors of the page DOM, resolved (no raw short-cut), http(s) only, deduplicated."""
    hrefs = href_array(html)
    def body(b: Column) -> Column:
        resolved = F.transform(hrefs, lambda h: U.resolve_url(h, b, keep_absolute_raw=False))
        return F.array_distinct(F.filter(resolved, lambda t: t.isNotNull() & t.rlike(r"^https?://")))
    return let(base, body)


def dom_links(df: DataFrame, html: str = "html", base: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return _explode(df, list(keep), dom_link_array(F.col(html), F.col(base)), "link")


# ---------------------------------------------------------------------------
# DuckDB twins: arrays unnested with their index; first occurrence by row_number.
# ---------------------------------------------------------------------------

def inline_link_array_sql(md: str) -> str:
    cond = " AND ".join(f"NOT starts_with(t, {sql_str(p)})" for p in SKIP_PREFIXES)
    return f"list_filter(regexp_extract_all({md}, {sql_str(INLINE_RE)}, 2), lambda t: {cond})"


def bare_link_array_sql(md: str) -> str:
    return f"regexp_extract_all({md}, {sql_str(BARE_RE)}, 0)"


def distinct_in_order_sql(src: str, keys: str, arr: str, name: str) -> str:
    """Rows (keys, pos, name) of ``arr`` with duplicates removed, first occurrence kept, pos renumbered."""
    return f"""(SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY i) AS INTEGER) AS pos, {name} FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys}, {name} ORDER BY i) AS rn FROM (
    SELECT {keys}, generate_subscripts(a, 1) AS i, unnest(a) AS {name} FROM (SELECT {keys}, {arr} AS a FROM {src}))
  WHERE {name} IS NOT NULL) WHERE rn = 1)"""

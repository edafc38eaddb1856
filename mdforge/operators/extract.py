"""H1, H2, H3, H6, H7: page metadata, article body, Markdown, gate, limited pages.

All narrow (no shuffle): each row is processed where it is read. The cleaning chain
is materialised once into a column so that later expressions reuse it instead of
re-running it per branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.regex import trim_ws

# Gate messages and limited-page text.
EMPTY_RESPONSE = "Empty response from server"
NO_ARTICLE = "Failed to extract article content"
LIMITED_ERROR = "Limited content extracted (JavaScript-rendered page)"
LIMITED_NOTE = "*Note: This page appears to be JavaScript-rendered. Limited content extracted.*"
NO_TEXT = "No text content available"
DEFAULT_HEADING = "Page Content"
MIN_CONTENT_CHARS = 50
LIMITED_TEXT_CHARS = 1000


def page_metadata(df: DataFrame, html: str = "html") -> DataFrame:
    """H1: page title column."""
    return df.withColumn("title", H.page_title(F.col(html)))


def main_content(df: DataFrame, html: str = "html") -> DataFrame:
    """H2: ``content_html`` (null = no article) and ``text``."""
    return (
        df.withColumn("_clean", H.clean_html(F.col(html)))
        .withColumn("content_html", H.main_content("_clean"))
        .drop("_clean")
        .withColumn("text", H.html_text(F.col("content_html")))
    )


def html_to_markdown(df: DataFrame, content: str = "content_html", out: str = "markdown") -> DataFrame:
    """H3: GFM Markdown of an HTML column."""
    return df.withColumn(out, H.html_to_markdown(content))


def limited_markdown(title: Column, text: Column) -> Column:
    """H7 body: heading, note, then the first 1000 characters of text + '...'."""
    body = F.when((text.isNull()) | (text == ""), F.lit(NO_TEXT)).otherwise(
        F.concat(F.substring(text, 1, LIMITED_TEXT_CHARS), F.lit("..."))
    )
    heading = F.coalesce(F.nullif(title, F.lit("")), F.lit(DEFAULT_HEADING))
    return F.concat(F.lit("# "), heading, F.lit("\n\n" + LIMITED_NOTE + "\n\n"), body)


def limited_page(df: DataFrame, url: str = "url") -> DataFrame:
    """H7 as an operator: the limited body and title a page would get."""
    return df.withColumn("limited_markdown", limited_markdown(F.col("title"), F.col("text"))).withColumn(
        "limited_title", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col(url))
    )


def gate_status(html: Column, content: Column) -> Column:
    """H6 in reference order: blank html, no article, content HTML shorter than 50."""
    return (
        F.when(html.isNull() | (trim_ws(html) == ""), F.lit("empty"))
        .when(content.isNull(), F.lit("no_article"))
        .when(F.length(trim_ws(content)) < MIN_CONTENT_CHARS, F.lit("limited"))
        .otherwise(F.lit("ok"))
    )


def content_gate(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """H6 + H7 + H3: one result row per page, failures kept as rows.

    Output adds ``status`` (ok / limited / empty / no_article), ``title``, ``markdown``
    and ``error``. Markdown is only built for pages that pass the gate.
    """
    staged = main_content(page_metadata(df, html), html).withColumn(
        "status", gate_status(F.col(html), F.col("content_html"))
    )
    md_ok = H.html_to_markdown("content_html")
    return (
        staged.withColumn(
            "markdown",
            F.when(F.col("status") == "ok", md_ok)
            .when(F.col("status") == "limited", limited_markdown(F.col("title"), F.col("text")))
            .otherwise(F.lit("")),
        )
        .withColumn(
            "title",
            F.when(F.col("status") == "limited", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col(url)))
            .when(F.col("status") == "ok", F.col("title")),
        )
        .withColumn(
            "error",
            F.when(F.col("status") == "empty", F.lit(EMPTY_RESPONSE))
            .when(F.col("status") == "no_article", F.lit(NO_ARTICLE))
            .when(F.col("status") == "limited", F.lit(LIMITED_ERROR)),
        )
    )


# ---------------------------------------------------------------------------
# H4: block table behind the Markdown (position, tag, text of each block)
# ---------------------------------------------------------------------------
from ..functions.regex import sql_str  # noqa: E402

BLOCK_OPEN = r"(?is)<(h[1-6]|p|li|pre|blockquote|table|tr|th|td|ol|ul|dt|dd|figcaption)\b[^>]*>"


def html_block_array(content: Column) -> Column:
    """array<struct<tag, inner>>: every block-opening tag in document order with the
    text up to the next block-opening tag (tags stripped, entities decoded, trimmed)."""
    tags = F.regexp_extract_all(content, F.lit(BLOCK_OPEN), 1)
    pieces = F.split(content, BLOCK_OPEN)
    after = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(
        F.arrays_zip(tags.alias("tag"), after.alias("raw")),
        lambda z: F.struct(F.lower(z["tag"]).alias("tag"), H.html_text(z["raw"]).alias("inner")),
    )


def html_blocks(df: DataFrame, content: str = "content_html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """H4: (keep..., pos, tag, inner) - ordered list numbers and table headers can be
    derived from it with windows over ``pos`` inside one page."""
    out = df.select(*keep, F.posexplode(html_block_array(F.col(content))).alias("pos", "_b"))
    return out.select(*keep, (F.col("pos") + 1).cast("int").alias("pos"), F.col("_b.tag").alias("tag"), F.col("_b.inner").alias("inner"))


def html_block_tree(df: DataFrame, content: str = "content_html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """H4 as the tree behind H3: (keep..., pos, parent, depth, tag, post, markdown).

    One row per block element. ``pos`` numbers all elements of the page in the order they
    open (inline ones take numbers too), ``post`` the blocks in the order they close;
    ``parent`` is the ``pos`` of the element around, 0 at the top. A block is inside another
    if its ``pos`` is larger and its ``post`` smaller. ``markdown`` is the block's own.
    """
    blocks = df.select(*keep, F.posexplode(H.dom.rendered_column(content)["blocks"]).alias("_post", "_b"))
    return blocks.select(
        *keep, F.col("_b.id").alias("pos"), F.col("_b.parent").alias("parent"), F.col("_b.depth").alias("depth"), F.col("_b.tag").alias("tag"),
        (F.col("_post") + 1).cast("int").alias("post"), H.finished(F.col("_b.markdown")).alias("markdown"),
    )


def html_blocks_sql(src: str, content: str = "content_html", key: str = "page_id") -> str:
    tags = f"regexp_extract_all({content}, {sql_str(BLOCK_OPEN)}, 1)"
    pieces = f"regexp_split_to_array({content}, {sql_str(BLOCK_OPEN)})"
    return (
        f"SELECT {key}, CAST(generate_subscripts(t, 1) AS INTEGER) AS pos, lower(unnest(t)) AS tag, "
        f"unnest(list_transform(p[2:], lambda r: {H.html_text_sql('r')})) AS inner FROM "
        f"(SELECT {key}, {tags} AS t, {pieces} AS p FROM {src})"
    )

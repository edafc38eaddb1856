"""Per-seed combined document, error report and read summary.

A seed's pages are bounded by its page budget (the input is a crawl with a budget), so
the ordered per-seed aggregate (``collect_list`` of (ord, part) sorted, then joined)
holds at most ``max_pages`` structs per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Combined-document markers and messages.
SEPARATOR = "\n\n---\n\n"
NO_RESULTS = "No results returned"
ERRORS_PREFIX = "Some pages had errors: "


def _page(order: str):
    """One page of the combined document, in visit order: after its source comment, errors
    as a comment, ``---`` before every non-error page but the first."""
    source = F.concat(F.lit("<!-- Source: "), F.col("url"), F.lit(" -->\n"), F.coalesce(F.col("markdown"), F.lit("")))
    failed = F.concat(F.lit("<!-- Error fetching "), F.col("url"), F.lit(": "), F.col("error"), F.lit(" -->"))
    piece = F.when(F.col("error").isNotNull(), failed).otherwise(F.concat(F.when(F.col(order) > 1, F.lit(SEPARATOR)).otherwise(F.lit("")), source))
    failed_url = F.when(F.col("error").isNotNull(), F.col("url"))
    return F.struct(F.col(order), piece.alias("piece"), failed_url.alias("failed"), "title", F.col("seed_error").alias("aborted"), "links")


def _per_seed(results: DataFrame, seed: str, order: str) -> DataFrame:
    """One aggregate over a seed's pages: everything that the answers below need.

    A crawl that the policy aborted (``seed_error``) has no page and no Markdown, and the
    policy's message is its error.
    """
    if "seed_error" not in results.columns:
        results = results.withColumn("seed_error", F.lit(None).cast("string"))
    if "links" not in results.columns:
        results = results.withColumn("links", F.lit(None).cast("array<string>"))
    agg = results.groupBy(seed).agg(F.array_sort(F.collect_list(_page(order))).alias("_p"))
    failed = F.filter(F.transform("_p", lambda p: p["failed"]), lambda u: u.isNotNull())
    aborted = F.element_at(F.transform("_p", lambda p: p["aborted"]), 1)
    gone = aborted.isNotNull()
    return agg.select(
        seed,
        F.when(gone, F.lit(0)).otherwise(F.size("_p")).cast("long").alias("n_pages"),
        F.when(gone, F.lit("")).otherwise(F.array_join(F.transform("_p", lambda p: p["piece"]), "\n")).alias("markdown"),
        F.coalesce(aborted, F.when(F.size(failed) > 0, F.concat(F.lit(ERRORS_PREFIX), F.array_join(failed, ", ")))).alias("error"),
        F.when(~gone, F.element_at("_p", 1)["title"]).alias("title"),
        F.when(gone, F.array().cast("array<string>")).otherwise(
            F.flatten(F.transform("_p", lambda p: F.coalesce(p["links"], F.array().cast("array<string>"))))
        ).alias("links"),
    )


def combine_pages(results: DataFrame, seed: str = "seed", order: str = "ord") -> DataFrame:
    """(seed, n_pages, markdown); an aborted read has no pages and an empty document."""
    return _per_seed(results, seed, order).select(seed, "n_pages", "markdown")


def error_report(results: DataFrame, seed: str = "seed", order: str = "ord") -> DataFrame:
    """The policy's message of an aborted read, else the failing URLs in visit order,
    else null."""
    return _per_seed(results, seed, order).select(seed, "error")


def read_summary(results: DataFrame, seed: str = "seed", order: str = "ord") -> DataFrame:
    """(seed, title, links, n_links, text, error, failed) as the tool would answer.

    ``results`` may carry ``seed_error`` (a crawl aborted by the policy) and ``links``
    (array), which are flattened over the pages in visit order.
    """
    one = _per_seed(results, seed, order)
    md, err = F.col("markdown"), F.col("error")
    text = (
        F.when(err.isNotNull() & (md != ""), F.concat(md, F.lit("\n\n---\n*Note: "), err, F.lit("*")))
        .when(err.isNotNull(), F.lit(None).cast("string"))
        .otherwise(md)
    )
    return one.select(
        seed, "title", "links", F.size("links").cast("long").alias("n_links"), text.alias("text"), "error",
        (err.isNotNull() & (md == "")).alias("failed"),
    )

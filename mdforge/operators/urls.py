"""URL inventory, canonical keys, dedupe, link resolution, same-origin filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import urlstandard as S


def url_inventory(df: DataFrame, col: str = "url") -> DataFrame:
    """Structural split, as the URL standard reads a URL; unparsable ones give null parts."""
    out = df.withColumn("_std", S.standard_column(col))
    for name in U.PARTS:
        out = out.withColumn(name, U.url_part(F.col("_std"), name))
    return out.withColumn("origin", U.url_origin(F.col("_std"))).drop("_std")


def url_counts(df: DataFrame, col: str = "url") -> DataFrame:
    """U1 summary: URLs per (scheme, host). Partial aggregation keeps a hot host cheap."""
    std = df.select(S.standard_column(col).alias("_std"))
    parts = std.select(U.url_part(F.col("_std"), "scheme").alias("scheme"), U.url_part(F.col("_std"), "host").alias("host"))
    return parts.groupBy("scheme", "host").agg(F.count(F.lit(1)).alias("n_urls"))


def normalize_urls(df: DataFrame, col: str = "url", out: str = "url_key") -> DataFrame:
    """Canonical key column; spellings that the URL standard takes for one URL share it.

    Null for what doesn't parse, a special URL with a host that can't be one included.
    """
    std = df.withColumn("_std", S.standard_column(col))
    host = U.host_unbracketed(F.coalesce(U.url_part(F.col("_std"), "host"), F.lit("")))
    refused = F.col("_std").rlike(f"(?i)^(?:{S.SPECIAL}):") & ~F.col("_std").rlike(S.PLAIN_RE) & (host.rlike(r"[^\x00-\x7f]") | host.contains("%"))
    return std.withColumn(out, F.when(~refused, U.normalize_url(F.col("_std")))).drop("_std")


def dedupe_urls(df: DataFrame, key: str = "url_key", order: str = "ord") -> DataFrame:
    """One row per key, the first by ``order`` wins.

    Written as an aggregate of ``min(struct(order, row))`` rather than a window:
    the aggregate combines map-side, so a key holding a third of all rows is reduced
    on every mapper before the shuffle instead of landing whole in one task.
    """
    others = [c for c in df.columns if c not in (key, order)]
    packed = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in others])
    agg = df.groupBy(key).agg(F.min(packed).alias("_first"))
    return agg.select(F.col(key), F.col("_first._o").alias(order), *[F.col("_first." + c).alias(c) for c in others])


def keep_computed(df: DataFrame, name: str, value, pred) -> DataFrame:
    """Add ``name = value`` and keep rows where ``pred(value)``, computing it once.

    A plain ``withColumn`` + ``filter`` lets the optimizer push the filter below the
    projection by substituting the expression, which evaluates it twice. Filtering a
    one-element array and exploding it (a generator) keeps a single evaluation.
    """
    return df.select("*", F.explode(F.filter(F.array(value), pred)).alias(name))


def barrier(df: DataFrame) -> DataFrame:
    """Make ``df``'s columns a boundary for the optimizer.

    Filters placed after an expensive projection are pushed below it by substituting
    the expressions, which evaluates them twice. Passing the row through a one-element
    generator keeps later filters above the computed values.
    """
    cols = df.columns
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in cols]))))


def resolve_links(df: DataFrame, link: str = "raw", base: str = "base", out: str = "target") -> DataFrame:
    """U4: absolute URL; unresolvable links are dropped.

    A link that begins with ``http://`` or ``https://`` stays as written. Others are read as
    the URL standard reads them on a page of ``base``: backslashes are slashes, tabs and
    newlines go, and a link with the base's scheme but no slashes is relative to it.
    """
    staged = df.withColumns({"_base": S.standard_column(base), "_link": S.standard_link_column(link, base)})
    raw = F.col(link).startswith("http://") | F.col(link).startswith("https://")
    resolved = F.when(raw, F.col(link)).otherwise(U.resolve_url(F.col("_link"), F.col("_base"), keep_absolute_raw=False))
    return keep_computed(staged, out, resolved, lambda t: t.isNotNull()).drop("_base", "_link")


def same_origin(df: DataFrame, link: str = "target", base: str = "base") -> DataFrame:
    """Keep links whose origin equals the base origin (bad link or base -> dropped)."""
    staged = df.withColumns({"_link": S.standard_column(link), "_base": S.standard_column(base)})
    pair = F.struct(U.url_origin(F.col("_link")).alias("lo"), U.url_origin(F.col("_base")).alias("bo"))
    kept = keep_computed(staged, "_origins", pair, lambda s: s["lo"].isNotNull() & (s["lo"] == s["bo"]))
    return kept.drop("_origins", "_link", "_base")

"""Result exports as DataFrames of text, plus writers.

Exports stay distributed: each row renders its own text and ``write.text`` writes
one file per partition; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JSON_FIELDS = ("url", "markdown", "title", "links", "error")


def export_json(results: DataFrame) -> DataFrame:
    """One JSON object per result (absent fields omitted, as JSON.stringify does)."""
    fields = [F.col(c) for c in JSON_FIELDS if c in results.columns]
    keys = [c for c in ("seed", "ord") if c in results.columns]
    return results.select(*keys, F.to_json(F.struct(*fields)).alias("json"))


def export_markdown(combined: DataFrame) -> DataFrame:
    """The combined document only (one per seed)."""
    return combined.select(*[c for c in ("seed",) if c in combined.columns], F.col("markdown").alias("text"))


def export_both(results: DataFrame) -> DataFrame:
    """Per page, ``## URL:`` heading block then its Markdown (stdout text), and the
    error line a reader would see (``Warning`` when Markdown exists, else ``Error``)."""
    md = F.coalesce(F.col("markdown"), F.lit(""))
    text = F.concat(
        F.lit("\n## URL: "), F.col("url"), F.lit("\n\n"),
        F.when(md != "", F.concat(md, F.lit("\n"))).otherwise(F.lit("")),
    )
    message = F.when(
        F.col("error").isNotNull(),
        F.concat(F.when(md != "", F.lit("Warning")).otherwise(F.lit("Error")), F.lit(": "), F.col("error")),
    )
    keys = [c for c in ("seed", "ord") if c in results.columns]
    return results.select(*keys, "url", text.alias("text"), message.alias("message"))


def write_text(df: DataFrame, column: str, path: str, order: tuple[str, ...] = (), rows_per_file: int = 0) -> None:
    """Text files of a column. With ``order`` the rows are range-partitioned and sorted, so
    the files, one after the other by name, hold them in that order; ``rows_per_file``
    bounds a file (0: as large as its partition)."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.select(F.col(column).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)


def write_json_lines(results: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """S9 as files: results in order of seed and visit, where they have these."""
    out = export_json(results)
    write_text(out, "json", path, tuple(c for c in ("seed", "ord") if c in out.columns), rows_per_file)

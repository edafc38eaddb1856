"""Captured pages as the source, response classification, redirects, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

RESPONSE_FIELDS = [
    T.StructField("status", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("content_type", T.StringType()),
]

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Tables whose rows carry whole documents: per-row CPU (regex chains, folds) dwarfs
# the scan.
WIDE_TABLES = ("pages", "documents", "conversations")
#: Partitions that wide tables are dealt to when they are read; unset: as scanned. A file
#: of one row group is one task however it is split, so local sessions set their cores
#: here; on a cluster it stays unset and no HTML is shuffled.
SPREAD_CONF = "spark.mdforge.read.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; Parquet gives column pruning and filter pushdown."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(SPREAD_CONF, None)
    return df.repartition(int(parts)) if parts and name in WIDE_TABLES else df


def scan_captures(spark: SparkSession, path: str, responses: bool = False) -> DataFrame:
    """Captured pages ``(page_id, url, html)`` with a fixed schema (no inference), with
    ``responses`` also ``(status, location, content_type)``.

    Columns that the files lack are null, others are left out, and a column of another type
    fails when it is read. An absent or empty folder has no captures. ``html`` is wide:
    callers should select it only where extraction needs it, so that URL-only stages
    (policy, dedupe, cache lookups) read just the narrow columns.
    """
    schema = T.StructType([*PAGES_SCHEMA.fields, *(RESPONSE_FIELDS if responses else [])])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# ---------------------------------------------------------------------------
# One HTTP response -> redirect / error / accepted body, in the reference order.
# ---------------------------------------------------------------------------

def classify_response(url: Column, status: Column, location: Column, content_type: Column) -> Column:
    """Struct ``(kind, error)``; kind in redirect/error/ok."""
    is_redirect = (status >= 300) & (status < 400)
    no_location = location.isNull() | (location == "")
    ok = (status >= 200) & (status < 300)
    bad_type = (
        content_type.isNotNull()
        & ~F.contains(content_type, F.lit("text/html"))
        & ~F.contains(content_type, F.lit("application/xhtml+xml"))
    )
    kind = (
        F.when(is_redirect & no_location, "error")
        .when(is_redirect, "redirect")
        .when(~ok, "error")
        .when(bad_type, "error")
        .otherwise("ok")
    )
    error = (
        F.when(is_redirect & no_location, F.concat(F.lit("Redirect without Location header for "), url))
        .when(is_redirect, F.lit(None).cast("string"))
        .when(~ok, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" for "), url))
        .when(bad_type, F.concat(F.lit("Non-HTML content type: "), content_type, F.lit(" for "), url))
    )
    return F.struct(kind.alias("kind"), error.alias("error"))


def classify_responses(hops: DataFrame) -> DataFrame:
    """S2 over a ``hops(url, status, location, content_type, ...)`` table."""
    c = classify_response(F.col("url"), F.col("status"), F.col("location"), F.col("content_type"))
    return hops.withColumn("_c", c).withColumn("kind", F.col("_c.kind")).withColumn(
        "error", F.col("_c.error")
    ).drop("_c")

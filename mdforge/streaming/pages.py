"""Captured pages arriving as files, processed once per URL; cache filled
incrementally.

A Structured Streaming query reads the page files; every micro-batch goes through the
batch plan of ``read_pages``. The first capture of a canonical URL (by ``page_id``) is
chosen on URL and id columns, so no HTML is shuffled to find duplicates, and the keys that
earlier batches have written are left out by a join with the result table itself: that
table is the state, on storage, whatever its size. T2 writes each micro-batch into the
append-only cache table; the streaming checkpoint makes a re-run add nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..plans.read_pages import canonical, first_captures, read_pages
from ..sources import cache as C
from ..sources.captures import PAGES_SCHEMA

STREAM_COLS = ("url_key", "page_id", "url", "title", "markdown", "error", "status")


def page_stream(spark: SparkSession, source_dir: str, glob: str | None = None) -> DataFrame:
    """Streaming DataFrame of captured pages, file by file."""
    reader = spark.readStream.schema(PAGES_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(source_dir)


def table_stream(spark: SparkSession, sf_dir: str, name: str = "pages") -> DataFrame:
    """Streaming DataFrame of a pages table: a folder of files, or one file.

    A stream reads folders only, and the filter by name goes for the files in them: it
    finds a table of one file in the folder around it, none of the files of a folder.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return page_stream(spark, path.toString())
    return page_stream(spark, sf_dir, f"{name}.parquet")


def read_batch(batch: DataFrame, host_addresses: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``STREAM_COLS`` for the URLs of a micro-batch that ``known(url_key)`` doesn't hold."""
    first = first_captures(batch)
    if known is not None:
        first = first.join(known, F.col("_cap_key") == F.col("url_key"), "left_anti")
    requests = first.select("url", F.col("_cap_ord").alias("ord"))
    out = read_pages(requests, batch, host_addresses)
    return out.select(canonical(F.col("request_url")).alias("url_key"), F.col("ord").alias("page_id"), *STREAM_COLS[2:])


def no_results(spark: SparkSession) -> DataFrame:
    """The result table of T1 before any page."""
    return spark.createDataFrame([], ", ".join(f"{c} {'long' if c == 'page_id' else 'string'}" for c in STREAM_COLS))


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The result table of T1; None before the first batch."""
    try:
        return spark.read.parquet(path).select(*STREAM_COLS)
    except AnalysisException:
        return None


def stream_read_pages(stream: DataFrame, out_path: str, checkpoint: str, host_addresses: DataFrame) -> None:
    """Drain what is available into the table ``out_path``, one row per canonical URL.

    A batch writes a folder of its own, named by the streaming checkpoint and the batch, so
    a repeated batch replaces itself and another checkpoint replaces nothing.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = read_results(spark, out_path)
        if done is not None:
            own = F.col("_metadata.file_path").contains(f"/run={run}/epoch={epoch}/")
            done = spark.read.parquet(out_path).filter(~own).select("url_key")
        read_batch(batch, host_addresses, done).write.mode("overwrite").parquet(f"{out_path}/run={run}/epoch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_cache_put(stream: DataFrame, cache_path: str, checkpoint: str, host_addresses: DataFrame) -> None:
    """Every micro-batch's fully extracted pages appended to the cache table.

    A batch gets the next version of the table, not its epoch, which starts anew with
    every checkpoint; a batch that is repeated is only written again.
    """
    def put(batch: DataFrame, epoch: int) -> None:
        C.cache_put(read_batch(batch, host_addresses), cache_path)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

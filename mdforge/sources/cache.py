"""The Markdown content table keyed by the SHA-256 of the URL (the cache).

Layout: ``data/put=<name>/key_prefix=<two hex digits>/`` holds the Parquet files of one put,
``snapshots/<n>`` names the puts of the n-th state of the cache, with their versions. A put
writes its files first and then a snapshot that names them too, which a rename brings
into being: readers take the last snapshot and never see half a put, and clearing is a
snapshot without puts. Of writers that end at the same time one finds its number taken and
tries the next.

Readers keep the latest entry per key with a map-side-combined aggregate. A lookup reads
the partitions of its requests' keys only. ``cache_compact`` puts the latest entries
together; ``cache_vacuum`` deletes files that the last snapshot doesn't name.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("url_key", T.StringType(), False),
        T.StructField("url", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("markdown", T.StringType(), True),
        T.StructField("n_bytes", T.LongType(), True),
        T.StructField("written_at", T.LongType(), True),
        T.StructField("key_prefix", T.StringType(), True),
    ]
)


def cache_key(url_col):
    """SHA-256 (hex) of the canonical URL."""
    return F.sha2(U.normalize_url(url_col), 256)


def cache_entries(results: DataFrame, batch: int = 0) -> DataFrame:
    """Rows a put would store: only fully extracted pages (no error), keyed by the
    **final** URL."""
    ok = results.filter(F.col("error").isNull() & F.col("markdown").isNotNull())
    key = cache_key(F.col("url"))
    return ok.select(
        key.alias("url_key"),
        F.col("url"),
        F.col("title"),
        F.col("markdown"),
        (F.coalesce(F.octet_length("markdown"), F.lit(0)) + F.coalesce(F.octet_length("title"), F.lit(0))).cast("long").alias("n_bytes"),
        F.lit(batch).cast("long").alias("written_at"),
        F.substring(key, 1, 2).alias("key_prefix"),
    )


# ---------------------------------------------------------------------------
# Snapshots
# ---------------------------------------------------------------------------

def _files(spark: SparkSession, path: str):
    """(file system of a path, function making a path below it)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, lambda *below: hadoop.Path("/".join([path.rstrip("/"), *below]))


def snapshot(spark: SparkSession, path: str) -> tuple[int, list[tuple[str, int]]]:
    """(number, [(put, version)]) of the cache's last state; (0, []) if there is none."""
    fs, at = _files(spark, path)
    if not fs.exists(at("snapshots")):
        return 0, []
    names = [f.getPath().getName() for f in fs.listStatus(at("snapshots"))]
    last = max((int(n) for n in names if n.isdigit()), default=0)
    if not last:
        return 0, []
    stream = fs.open(at("snapshots", f"{last:012d}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return last, [(name, int(version)) for name, version in (line.split() for line in text.splitlines())]


def _commit(spark: SparkSession, path: str, change) -> None:
    """Bring ``change`` (of the list of puts) into being as the next snapshot."""
    fs, at = _files(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(at().toUri(), spark._jsc.hadoopConfiguration())
    fs.mkdirs(at("snapshots"))
    while True:
        number, puts = snapshot(spark, path)
        draft = at("snapshots", f"draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray("".join(f"{name} {version}\n" for name, version in change(puts)).encode()))
        stream.close()
        try:
            # Without the option to overwrite: it fails where another writer was first.
            options = spark._sc._gateway.new_array(hadoop.Options.Rename, 0)
            context.rename(fs.makeQualified(draft), fs.makeQualified(at("snapshots", f"{number + 1:012d}")), options)
            return
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise


def next_version(spark: SparkSession, path: str) -> int:
    """One more than the largest version in the cache: grows over writers and runs.

    Of puts that run at the same time and get one version, the greater title and Markdown
    win (a fixed rule for ties).
    """
    return max((version for _, version in snapshot(spark, path)[1]), default=0) + 1


def cache_put(results: DataFrame, path: str, batch: int | None = None) -> None:
    """Add this batch's entries; the latest version wins on read. A put without a
    number of its own gets the next version of the cache."""
    spark = results.sparkSession
    if batch is None:
        batch = next_version(spark, path)
    name = uuid.uuid4().hex
    cache_entries(results, batch).write.partitionBy("key_prefix").parquet(f"{path}/data/put={name}")
    _commit(spark, path, lambda puts: [*puts, (name, batch)])


def _raw(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """All versions of the entries of the last snapshot, of the given key prefixes only."""
    fs, at = _files(spark, path)
    folders = [f"{path}/data/put={name}" for name, _ in snapshot(spark, path)[1] if fs.exists(at("data", f"put={name}"))]
    if not folders:
        return spark.createDataFrame([], CACHE_SCHEMA)
    put = T.StructField("put", T.StringType(), True)
    raw = spark.read.schema(T.StructType([*CACHE_SCHEMA.fields, put])).option("basePath", f"{path}/data").parquet(*folders).drop("put")
    return raw if prefixes is None else raw.filter(F.col("key_prefix").isin(prefixes))


def read_cache(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """Latest entry per key; an absent cache reads as empty. ``prefixes``: partitions to read."""
    return latest_entries(_raw(spark, path, prefixes))


def latest_entries(raw: DataFrame) -> DataFrame:
    cols = [c for c in CACHE_SCHEMA.fieldNames() if c not in ("url_key", "written_at")]
    best = raw.groupBy("url_key").agg(F.max(F.struct("written_at", *cols)).alias("_e"))
    return best.select("url_key", *[F.col("_e." + c).alias(c) for c in ["written_at", *cols]])


def cache_lookup(requests: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """Every request with ``hit``, ``cached_title`` and ``cached_markdown`` (null for
    a miss) by its canonical **request** URL, in one join. Hits carry no links; misses go
    on to robots and fetch."""
    req = requests.withColumn("url_key", cache_key(F.col(url)))
    entries = cache.select(F.col("url_key").alias("_ck"), F.col("title").alias("cached_title"), F.col("markdown").alias("cached_markdown"))
    out = req.join(entries, F.col("url_key") == F.col("_ck"), "left")
    return out.withColumn("hit", F.col("_ck").isNotNull()).drop("_ck")


def cache_lookup_at(requests: DataFrame, path: str, url: str = "url") -> DataFrame:
    """S6 against the cache at ``path``: only the partitions that the requests' keys fall
    into are read (their two-digit prefixes, at most 256, are gathered first)."""
    keys = requests.select(F.substring(cache_key(F.col(url)), 1, 2).alias("p")).where("p is not null").distinct()
    prefixes = sorted(r["p"] for r in keys.collect())
    return cache_lookup(requests, read_cache(requests.sparkSession, path, prefixes), url)


def cache_status(cache: DataFrame) -> DataFrame:
    """Entry count, byte total and ``x.xx MB``; an empty cache gives zeros."""
    agg = cache.agg(F.count(F.lit(1)).alias("cache_files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("cache_size"))
    return agg.select(
        "cache_size",
        "cache_files",
        F.format_string("%.2f MB", F.col("cache_size") / 1024.0 / 1024.0).alias("cache_size_formatted"),
    )


def cache_clear(spark: SparkSession, path: str) -> DataFrame:
    """An empty cache from now on; succeeds when nothing was there. Readers that have
    begun go on with the files they know, which ``cache_vacuum`` deletes."""
    _commit(spark, path, lambda puts: [])
    return spark.createDataFrame([("success", "Cache cleared successfully")], "status string, message string")


def cache_compact(spark: SparkSession, path: str) -> None:
    """The latest entries of the last snapshot as one put; puts that come meanwhile stay."""
    old = snapshot(spark, path)[1]
    name = uuid.uuid4().hex
    entries = read_cache(spark, path).select(*CACHE_SCHEMA.fieldNames())
    entries.repartition("key_prefix").write.partitionBy("key_prefix").parquet(f"{path}/data/put={name}")
    version = max((v for _, v in old), default=0)
    _commit(spark, path, lambda puts: [(name, version), *(p for p in puts if p not in old)])


def cache_vacuum(spark: SparkSession, path: str) -> int:
    """Delete the puts that the last snapshot doesn't name, those of readers and writers at
    work included: call it when there are none. Returns how many."""
    fs, at = _files(spark, path)
    if not fs.exists(at("data")):
        return 0
    live = {f"put={name}" for name, _ in snapshot(spark, path)[1]}
    gone = [f.getPath() for f in fs.listStatus(at("data")) if f.getPath().getName() not in live]
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)

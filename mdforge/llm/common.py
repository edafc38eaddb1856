"""What the operators of this package share: shared-folder tables, Arrow helpers, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdforge.session import ensure_checkpoint_dir

#: The word of the contracts: a run of bytes other than the six ASCII white-space ones.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch and in one of the Parquet reader: texts reach some hundred kB, so a
#: batch stays within ~50 MB. Spark's 4096 texts or sets at a time make buffers of 16 to 32 MB,
#: and an executor's heap grows with them.
BATCH_ROWS = 500


def ready(spark: SparkSession) -> str:
    """Shared folder of this session; also lets Python workers import this package."""
    folder = ensure_checkpoint_dir(spark)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for rows in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(rows)) != BATCH_ROWS:
            spark.conf.set(rows, str(BATCH_ROWS))
    return folder


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it: cuts the lineage.

    The files outlive a lost executor, and later plans start from a columnar scan.
    """
    spark = df.sparkSession
    path = f"{ready(spark)}/mdforge-{name}-{uuid.uuid4().hex}"
    for paths in _scratch:
        paths.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _settled_at[table] = path
    return table


_settled_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scratch: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unsettle(*tables: DataFrame) -> None:
    """Delete the files of settled tables that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, _settled_at.pop(t))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside go at the end: what is made of them is to be written by then."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch[:] = [x for x in _scratch if x is not paths]
        for path in paths:
            _delete(spark, path)


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """What this worker keeps between tasks: one model or cache at a time."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what the worker keeps and give freed memory back to the system."""
    _held.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the system, Arrow's too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, keeps: bool = False) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``; ``schema`` is the DDL of what it returns.

    Workers serve one stage after another: unless ``fn`` ``keeps`` a model by ``held``, a
    task first drops what an earlier stage has left. What a task has freed goes back to the
    system at its end: workers also stay through stages that don't need them.
    """
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps and _held:
            release()
        for b in batches:
            if b.num_rows:
                yield fn(b)
        trim()

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (id, label) with label the smallest id reachable.

    ``edges`` has two bigint columns. Alternates large-star and small-star steps; each is
    one minimum per node, combined map-side, and a join back, so a node with a third of
    all edges is neither collected nor handled by one task (AQE splits the join). Every
    round is settled in the shared folder; no edge or label reaches the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = settle(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = e.select(F.col("u").alias("id")).union(e.select(F.col("v").alias("id"))).distinct()
    while True:
        # Large star: every larger neighbour of a node points to the node's smallest.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        nxt = settle(nxt.where("u <> v").distinct(), "edges")
        if _is_stars(nxt):
            break
        e = nxt
    return nodes.join(nxt, nodes.id == nxt.u, "left").select("id", F.coalesce("v", "id").alias("label"))


def _is_stars(e: DataFrame) -> bool:
    """Every node points to one smaller node, and none of those points further."""
    many = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    chain = e.alias("x").join(e.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi")
    return many.select("u").union(chain.select("u")).isEmpty()

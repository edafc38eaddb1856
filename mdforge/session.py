"""Session helpers: a tuned local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults for a session this package creates itself (tests, bench). On a cluster the
# job is handed an existing session and these are not applied.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Extraction after a join is CPU-heavy per byte: keep its partitions small.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Pages are wide rows: size scan splits by bytes, not rows.
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "mdforge") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if str(cpus).isdigit():
        builder = builder.config("spark.mdforge.read.partitions", str(cpus))
    builder = builder.config("spark.driver.memory", os.environ.get("MDFORGE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared, fault-tolerant folder and is only read.
    Only when it is unset (local tests) a private scratch folder is created.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="mdforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return spark.sparkContext.getCheckpointDir() or current


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage (a lost executor recomputes nothing before it), and what is used
    several times is computed once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Bucketed:
    """A growing table in the shared folder, bucketed by ``keys``.

    A join on the keys reads it bucket by bucket, without moving it: only the other side is
    dealt out. Appends add files to the buckets. The table stands in the session's catalog
    until it is dropped; its files stay, like those of ``settle``.
    """

    def __init__(self, spark: SparkSession, name: str, *keys: str) -> None:
        self.spark, self.keys = spark, keys
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"mdforge_{name}_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{self.table}"

    def append(self, df: DataFrame) -> None:
        dealt = df.repartition(self.buckets, *self.keys)
        dealt.write.bucketBy(self.buckets, *self.keys).option("path", self.path).mode("append").format("parquet").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> DataFrame:
        """Leave the catalog; the rows as a plain table."""
        schema = self.read().schema
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        return self.spark.read.schema(schema).parquet(self.path)

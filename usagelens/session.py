"""Session settings, and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# SQL settings the operators rely on. All are session-level and can be set on a
# session somebody else created.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even when that costs the next operator its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # JSON objects with a repeated key keep the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A repeated map key keeps the last value, as manifest attributes do.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What a Python worker holds at once is bounded in bytes, since an archive or a page is of any size.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "usagelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A local session may leave
    it unset and gets a temporary folder; a cluster session must name one, since
    a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="usagelens-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


# The codec of large tables. Names and hashes take half the disk that they take in Spark's default one.
DENSE = "zstd"


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends at files that survive executors, and Catalyst sees their real
    size, so its broadcast decisions rest on measured bytes. It also lets AQE split
    a hot key on the other side of a join: AQE only splits joins of two plain
    shuffles, not ones where a side was aggregated by the join key just before.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def condense(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` for large tables with the rows of a run.

    Small sides of joins are not for it: the denser a file, the less its size tells of what a broadcast takes.
    """
    return materialize(df, label, DENSE)


class Scratch:
    """Tables of one run that are deleted when they are no longer read, and at its end.

    They stand in a database of their own whose folder lies in the shared folder, so that
    dropping them removes their files. With ``key`` a table is laid out in buckets of it,
    sorted by ``order``: later joins on the key need no shuffle.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.name = spark, f"{label}_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{os.path.join(shared_dir(spark), self.name)}'")

    def write(
        self, df: DataFrame, table: str, key: str | tuple[str, ...] = (), buckets: int = 0, order: tuple[str, ...] = ()
    ) -> DataFrame:
        writer = df.write.format("parquet")
        keys = (key,) if isinstance(key, str) else key
        if keys:
            writer = writer.bucketBy(buckets, *keys)
        if order:
            writer = writer.sortBy(*order)
        writer.saveAsTable(f"{self.name}.{table}")
        return self.table(table)

    def append(self, df: DataFrame, table: str, key: tuple[str, ...], buckets: int, part: str, path: str) -> None:
        """Add rows, in buckets of ``key`` and folders by ``part``, to a table whose files at ``path`` outlive the run."""
        writer = df.write.format("parquet").mode("append").partitionBy(part).bucketBy(buckets, *key)
        writer.option("path", path).saveAsTable(f"{self.name}.{table}")

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}.{table}")

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}.{table}")

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of the session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that no reader needs any more: dropping a database deletes its folder."""
    name = f"gone_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    spark.sql(f"DROP DATABASE {name} CASCADE")


def write_counted(df: DataFrame, path: str) -> int:
    """Write ``df`` and return its row count, without a second job to count it."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return seen.get["rows"]


def at_once(action: Callable, names: Iterable, width: int = 8) -> list:
    """Hand independent jobs to Spark together, so that they share the cluster."""
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(action, names))

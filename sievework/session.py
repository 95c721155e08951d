"""Session construction and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app_name: str = "sievework") -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster the caller brings its own session; nothing in the package depends on the
    settings below except the UTC time zone.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one up only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action are removed when it ends, not when the driver's heap happens
    to be collected.  For steps that write a table and read that one only."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    try:
        before = spark.conf.get(name)
    except PySparkException:  # not known to this Spark version
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that Spark uses for it."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder beside the checkpoints that is deleted at the end."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove_folder(spark, path)


class Scratch:
    """Tables in a scratch folder: called with one, it writes it and continues from the written copy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.made += 1
        df.write.parquet(f"{self.folder}/{self.made}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.made}")

    def drop(self, first: int, last: int) -> None:
        """Deletes the tables numbered ``first`` to ``last``, which nothing reads any more."""
        for i in range(first, last + 1):
            remove_folder(self.spark, f"{self.folder}/{i}")


def union_rows(parts: Iterable[DataFrame]) -> DataFrame:
    """Row union by column name.

    Spark 4.1 can zip the inputs of a union partition by partition when they are hashed alike,
    which fails if adaptive execution re-partitions one of them; that setting is turned off.
    """
    parts = list(parts)
    try:
        parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    except PySparkException:  # not known to this Spark version
        pass
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parallelism(df: DataFrame) -> int:
    """Number of slices worth cutting a hot group into on this session."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, n)

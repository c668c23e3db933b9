"""Session defaults and the two places where a job touches shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(app_name: str = "pagemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, local mode) is a folder of our own made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="pagemill-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/pagemill/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: an iterative plan stays short and survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later plans see its true size."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of this library; any other path is refused."""
    if not path.startswith(f"{shared_dir(spark)}/pagemill/"):
        raise ValueError(f"{path} is not an intermediate table")
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@dataclass(frozen=True)
class StoredTable:
    """Rows stored in buckets in the shared folder, under a table name of their own."""

    rows: DataFrame
    name: str
    path: str

    def drop(self) -> None:
        """Forget the table and delete its files."""
        spark = self.rows.sparkSession
        spark.sql(f"drop table if exists {self.name}")
        discard(spark, self.path)


def store_bucketed(df: DataFrame, label: str, keys: Sequence[str], buckets: int) -> StoredTable:
    """Write ``df`` in ``buckets`` buckets of ``keys`` to the shared folder: joins on these keys find the rows of a
    bucket together, so they are not dealt out again. One task writes one bucket."""
    spark = df.sparkSession
    path, name = scratch_path(spark, label), f"pagemill_{label}_{uuid.uuid4().hex[:12]}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return StoredTable(spark.table(name), name, path)

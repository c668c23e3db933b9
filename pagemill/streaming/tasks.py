"""Task messages: specifications that arrive as a stream of JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.sources.specs import SplitSpecs, split_specs

TASK_SCHEMA = T.StructType(
    [
        T.StructField("msg_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("redelivered", T.BooleanType()),
        T.StructField("body", T.StringType()),
    ]
)


MALFORMED = "malformed"


def stream_tasks(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Task files as they arrive, ``max_files`` per micro-batch. A line that is no task message has its text in
    ``malformed``, which is NULL for all others."""
    schema = T.StructType([*TASK_SCHEMA, T.StructField(MALFORMED, T.StringType())])
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", MALFORMED)
    return reader.option("maxFilesPerTrigger", max_files).json(path)


def split_tasks(tasks: DataFrame) -> SplitSpecs:
    """Task messages to specifications with their msg_id, apart from what is none: malformed messages and unreadable
    bodies. Of several tasks with one name the one with the greatest msg_id is accepted, the others are superseded."""
    bad = tasks.where(F.col(MALFORMED).isNotNull())
    split = split_specs(tasks.where(F.col(MALFORMED).isNull()).select("msg_id", "body"))
    last = split.accepted.groupBy("name").agg(F.max("msg_id").alias("msg_id"))
    older = split.accepted.join(last, ["name", "msg_id"], "left_anti")
    rejected = (
        bad.select("msg_id", F.col(MALFORMED).alias("body"), F.lit("malformed message").alias("reason"))
        .unionByName(split.rejected.select("msg_id", "body", "reason"))
        .unionByName(older.select("msg_id", F.col("name").alias("body"), F.lit("superseded").alias("reason")))
    )
    return SplitSpecs(split.accepted.join(last, ["name", "msg_id"], "left_semi"), rejected)


def drop_redelivered(tasks: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Discard redelivered messages and repeats of a message id.

    Ids are remembered for ``horizon`` after their arrival, which bounds the state. The time in a message
    plays no part, so no first delivery is late, however old it is. As with any at-most-once rule, a
    task whose first delivery was lost stays lost.
    """
    ids = [c for c in ("msg_id", MALFORMED) if c in tasks.columns]
    return (
        tasks.filter(~F.coalesce("redelivered", F.lit(False)))
        .withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", horizon)
        .dropDuplicatesWithinWatermark(ids)
        .drop("_arrived")
    )


def task_messages(specs: DataFrame) -> DataFrame:
    """Specification columns as the JSON body of a task."""
    return specs.select(F.col("name"), F.to_json(F.struct(*specs.columns)).alias("body"))


def send_tasks(tasks: DataFrame, path: str, mode: str = "append") -> None:
    """Write task rows as JSON files for :func:`stream_tasks`."""
    tasks.select(*TASK_SCHEMA.names).write.mode(mode).json(path)

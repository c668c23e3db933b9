"""Crawls that tasks start as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.language import LanguageModel
from pagemill.plans.crawl import run_crawls
from pagemill.session import materialize
from pagemill.streaming.tasks import drop_redelivered, split_tasks

OUTPUTS = ("visits", "paragraphs", "raw", "rejected")


def stream_crawls(
    spark: SparkSession,
    tasks: DataFrame,
    pages: DataFrame,
    path: str,
    checkpoint: str,
    model: LanguageModel | None = None,
    robots: DataFrame | None = None,
) -> StreamingQuery:
    """Run the specifications of each micro-batch of ``tasks`` over the table of captures, all at once, languages included.

    Repeated and redelivered messages are dropped. Results go to ``path``/visits, paragraphs, raw and rejected, below
    ``batch=<number>``. A batch that is replayed after a failure overwrites its folders, so each result is there once.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        split = split_tasks(materialize(batch, "tasks"))
        done = run_crawls(spark, split.accepted.drop("msg_id"), pages, model, robots)
        ids = split.accepted.select("name", "msg_id")
        refused = done.rejected.join(ids, "name").select("msg_id", F.col("name").alias("body"), "reason")
        outputs = (done.visits, done.paragraphs, done.raw, split.rejected.unionByName(refused))
        for name, rows in zip(OUTPUTS, outputs, strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    query = (
        drop_redelivered(tasks)
        .writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

"""Pages in, paragraph rows and result messages out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.paragraphs import DEFAULT_XPATHS, extract_paragraphs, route_content_type
from pagemill.sinks.messages import send_results
from pagemill.sources.pages import PAGES_SCHEMA


def stream_pages(spark: SparkSession, path: str, glob: str = "*", max_files: int | None = 1) -> DataFrame:
    """Captured pages as their files arrive; ``path`` is their folder (or a pattern, which may also match single files), and
    ``max_files`` of None takes all that lie there as one batch."""
    stream = spark.readStream.schema(PAGES_SCHEMA).option("pathGlobFilter", glob)
    return (stream.option("maxFilesPerTrigger", max_files) if max_files else stream).parquet(path)


def stream_parse(pages: DataFrame, xpaths: Sequence[str] = DEFAULT_XPATHS) -> DataFrame:
    """Responses to paragraph rows: the batch operators unchanged, all of them narrow, no state."""
    html = route_content_type(pages, ["text/html"]).filter(F.col("handler").isNotNull())
    return extract_paragraphs(html.drop("handler", "content_type"), xpaths)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there into a parquet sink; a restart with the same checkpoint goes on."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_results(
    stream: DataFrame, path: str, checkpoint: str, to_messages: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Turn each micro-batch to messages and write them under the batch's own folder.

    A batch that is replayed after a failure overwrites its folder, so each message is there once. From
    the second batch on, file names end with the batch's number, so the parts of a spider that arrive in
    several batches don't share a name.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        # Numbering and sizes read the batch more than once; parse it once.
        kept = batch.persist()
        try:
            messages = to_messages(kept)
            if batch_id:
                messages = messages.withColumn("filename", F.concat("filename", F.lit(f"_batch{batch_id}")))
            send_results(messages, f"{path}/batch={batch_id}", mode="overwrite")
        finally:
            kept.unpersist()

    query = (
        stream.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

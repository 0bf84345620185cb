"""Documents that arrive as files, classified in micro-batches.

Documents do not depend on each other, so no state or watermark is needed. Each
micro-batch runs the batch dataflow and writes a folder named by its batch id,
which makes a repeated batch overwrite itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lines import to_lines
from ..plans.pipelines import classify_documents
from ..sources.files import stem


def stream_texts(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of whole text files."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    named = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return named.select("path", F.xxhash64("path").alias("doc_id"), stem(F.col("path")).alias("name"), "text")


def classify_stream(docs: DataFrame, output: str, checkpoint: str, available_now: bool = True, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write the report of each arriving document as Parquet, once."""
    run = transform or (lambda batch: classify_documents(to_lines(batch)))

    def batch(rows: DataFrame, batch_id: int) -> None:
        run(rows).drop("timestamp").write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

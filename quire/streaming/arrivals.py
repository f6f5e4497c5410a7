"""PDF tables over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of (doc_id, content) over the files of a folder; every table of quire.sources.tables takes it as is."""
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)
    return stream.select(F.col("path").alias("doc_id"), "content")


def run(table: Callable[[DataFrame], DataFrame], source: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends a table of the arriving files to Parquet; the checkpoint makes each file count once. No state is kept."""
    return table(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

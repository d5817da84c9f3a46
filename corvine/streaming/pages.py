"""New pages as they come: a file stream through the same parsers as in batch, each file once.

Parsing keeps no state, so it runs unchanged on a stream; the checkpoint makes the sink see every file exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import musicxml, svg

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, pattern: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)


def stream_scores(spark: SparkSession, path: str, pattern: str = "*.musicxml") -> DataFrame:
    return musicxml.parse_column(stream_files(spark, path, pattern), "path", "content")


def stream_contours(spark: SparkSession, path: str, pattern: str = "*.svg") -> DataFrame:
    return svg.parse_column(stream_files(spark, path, pattern), "path", "content")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended to Parquet."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

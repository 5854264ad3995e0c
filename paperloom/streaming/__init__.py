"""Row-level operators over streams: they keep no state, so they run unchanged on a streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import split_lines


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) of text files as they arrive in a folder."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path)
    named = files.select(F.input_file_name().alias("path"), split_lines(F.col("value")).alias("l"))
    return named.select("path", F.posexplode("l").alias("pos", "line"))

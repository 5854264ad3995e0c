"""Folders of files as tables, and one file a row back to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.files import accepts, detect_container, format_bytes, looks_like_docx, looks_like_pdf
from paperloom.functions.text import split_lines


def read_files(spark: SparkSession, path: str, extensions: list[str] | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content, kind). The limit on length is pushed to the reader, so larger files aren't opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        found = found.where(F.col("length") <= most_bytes)
    if extensions:
        found = found.where(accepts(F.col("path"), F.lit(None).cast("string"), extensions, []))
    kind = F.coalesce(detect_container(F.col("content")), F.when(looks_like_pdf(F.col("content")), "pdf").when(looks_like_docx(F.col("content")), "docx"))
    return found.withColumn("kind", kind)


def read_texts(spark: SparkSession, path: str, most_bytes: int = 40 << 20) -> DataFrame:
    """(path, text, lines, reason) of whole UTF-8 files; larger ones aren't opened and have a reason instead of a text."""
    found = read_files(spark, path, most_bytes=most_bytes).select("path", F.decode("content", "UTF-8").alias("text"))
    large = read_files(spark, path).where(F.col("length") > most_bytes)
    reason = F.concat(F.lit("larger than "), format_bytes(F.lit(most_bytes)))
    refused = large.select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("lines"), reason.alias("reason"))
    return found.withColumn("lines", split_lines(F.col("text"))).withColumn("reason", F.lit(None).cast("string")).unionByName(refused)


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, mode): pictures that the JVM can decode (JPEG, PNG, GIF, BMP)."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.width", "image.height", "image.nChannels")

"""SRC4: image files with type, hash and size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapak.functions.values import image_extension, image_type

MAX_BYTES = 10 * 1024 * 1024


def scan_images(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Supported images of a folder: path, content_hash, content_type, extension, byte_size.

    The size bound is pushed to the file listing, so oversized files are never read; empty files are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return describe_images(files.filter((F.col("length") > 0) & (F.col("length") <= max_bytes)))


def describe_images(files: DataFrame) -> DataFrame:
    """Type by the first bytes and content hash of binary rows (path, length, content)."""
    typed = files.withColumn("content_type", image_type(F.col("content"))).filter(F.col("content_type").isNotNull())
    return typed.select(
        "path", F.sha2("content", 256).alias("content_hash"), "content_type",
        image_extension(F.col("content_type")).alias("extension"), F.col("length").alias("byte_size"))

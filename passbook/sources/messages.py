"""Messages as a table or a stream, and image-path checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passbook.functions.text import blank
from passbook.schema import SMS

# What the phone inbox scans, with and without a limit of its own.
PHONE_LIMIT = 500
PHONE_MOST = 2500

# File endings and prefixes that count as an image.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "webp")
IMAGE_PREFIXES = ("blob:", "data:")


def recent_sms(df: DataFrame, limit: int | None) -> DataFrame:
    """The newest messages; None keeps all of them. The phone's own limits are named above."""
    if limit is None:
        return df
    if limit <= 0:
        raise ValueError("a limit is positive, or None for all messages")
    return df.orderBy(F.desc("ts"), "sms_id").limit(limit)


def stream_sms(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Messages as they arrive in a folder, with event time fit for a watermark."""
    reader = spark.readStream.schema(SMS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def backlog(df: DataFrame) -> DataFrame:
    """Messages kept while the receiver was down, each once."""
    return df.dropDuplicates(["sender", "body", "ts"])


def check_paths(df: DataFrame, column: str = "path") -> DataFrame:
    """Adds ``is_valid`` and ``error`` for an image path."""
    path = F.lower(column)
    supported = path.rlike(r"\.(" + "|".join(IMAGE_ENDINGS) + r")\z") | path.rlike(
        "^(" + "|".join(IMAGE_PREFIXES) + ")"
    )
    error = F.when(blank(F.col(column)), "Empty image path").when(
        ~supported, "Unsupported image format. Please select PNG, JPG, or WEBP."
    )
    return df.withColumn("error", error).withColumn("is_valid", F.col("error").isNull())

"""Local images as rasters, and checks of a model file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(id, width, height, channels, data, error) of local image files; data is row-major, blue first. Files that can't be decoded stay, with an error."""
    rows = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    bad = F.col("width") <= 0
    return rows.select(F.col("origin").alias("id"), "width", "height", F.col("nChannels").alias("channels"), "data", F.when(bad, "decode").alias("error"))


def looks_like_onnx(data: bytes, expected: int = 0) -> bool:
    """Whether a downloaded file is a model rather than an error page: the protobuf tag, and a quarter of the expected size at most off."""
    if not data or len(data) < 1024 or (expected and abs(len(data) - expected) > expected * 0.25):
        return False
    return data[0] == 0x08

"""Stateless scorers over streams. The operators only project and explode, so a stream takes them as a table does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequences import letters
from seqloom.operators.tiling import tile


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def tiled(stream: DataFrame, text: str, k: int) -> DataFrame:
    return tile(stream.withColumn("_seq", letters(text)).drop(text), "_seq", [k])


def windowed_counts(stream: DataFrame, time: str, key: str, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, key, n: tumbling counts; rows later than `late` are left out once their window is closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")

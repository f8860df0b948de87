"""Replay of archived payloads: Parquet files with ts and data columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How the files of a topic are named: any word, the topic, a range of times and more.
FILES = "*_{topic}-*.parquet"


def glob_of(topic: str) -> str:
    return FILES.format(topic=re.sub(r"([\[\]{}?*\\])", r"\\\1", topic))


def read_history(spark: SparkSession, folder: str, topic: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """ts, data of a topic's files within [start, end]; the bounds reach the Parquet scan."""
    df = spark.read.option("pathGlobFilter", glob_of(topic)).parquet(folder).select(F.col("ts").cast("long").alias("ts"), F.col("data").cast("binary").alias("data"))
    df = df.where(F.col("ts") >= start) if start is not None else df
    return df.where(F.col("ts") <= end) if end is not None else df


def stream_history(spark: SparkSession, folder: str, topic: str, files_a_batch: int = 1) -> DataFrame:
    """The same files as a stream, so many a micro-batch."""
    return spark.readStream.schema("ts long, data binary").option("pathGlobFilter", glob_of(topic)).option("maxFilesPerTrigger", files_a_batch).parquet(folder)

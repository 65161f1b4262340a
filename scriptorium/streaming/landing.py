"""Scoring documents as they land in a folder: a stateless stream, so there is nothing to keep late data for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.functions import text as T
from scriptorium.operators import signals
from scriptorium.operators.features import featurize

SCHEMA = "id bigint, text string"


def landing(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files of (id, text), a bounded number of them in each step."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def scored(stream: DataFrame) -> DataFrame:
    rows = featurize(stream.select("id", T.normalized(F.col("text")).alias("text")).where("text <> ''"))
    return rows.select("id", F.col("f.word_count").alias("word_count"), signals.probability(F.col("f")).alias("ai_probability"))


def into_history(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends scores to a Parquet folder, each landed file exactly once."""
    writer = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()

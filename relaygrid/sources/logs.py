"""Files and tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaygrid import schemas


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ACCESS_LOG).json(path)


def read_consumer_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONSUMER_ERROR_LOG).json(path)


def read_producer_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PRODUCER_ERROR_LOG).json(path)


def parse_log_lines(lines: DataFrame, schema, column: str = "line") -> DataFrame:
    """Log records that arrive as text rows; broken lines are skipped."""
    parsed = lines.withColumn("_r", F.from_json(column, schema))
    first = schema.fields[0].name
    return parsed.where(F.col(f"_r.{first}").isNotNull()).select("*", "_r.*").drop("_r", column)


def read_topic_log(spark: SparkSession, path: str) -> DataFrame:
    """A stored log; filters on ``topic`` prune its folders."""
    return spark.read.schema(schemas.TOPIC_LOG).parquet(path)


def write_topic_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Store by topic.  Each task writes the topics it holds: no shuffle, and a
    topic with most of the rows is written by all tasks."""
    log.select(*schemas.TOPIC_LOG.fieldNames()).write.mode(mode).partitionBy("topic").parquet(path)


def read_messages(spark: SparkSession, path: str, model: str) -> DataFrame:
    """JSON-lines messages of one model."""
    return spark.read.schema(schemas.BY_MODEL[model]).json(path)


def read_blobs(spark: SparkSession, path: str, source: str, label: str, pattern: str = "*") -> DataFrame:
    """Uploads from files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.lit(source).alias("source"), F.lit(label).alias("label"),
        F.col("content").alias("data"), F.col("path").alias("upload_id"),
    )

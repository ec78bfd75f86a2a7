"""Records of the ingestion stream: publishing and reading, batch or stream.

A record is (key, value, partition, offset), the columns of Spark's Kafka
source, so jobs do not care whether files or a broker delivered it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventtally.schema import (
    DEAD_LETTER_SUFFIX, RECORD, TOPIC, TOPIC_PARTITIONS,
)
from eventtally.session import settings

_COLUMNS = ("key", "value", "partition", "offset")

#: Bytes of a row group of published files.  A task reads whole ones, so that of a large file many tasks parse a share.
ROW_GROUP = 4 << 20

#: Batches a task stages at a time; of more, the rest of its rows is sorted by batch first.
OPEN_BATCHES = 32
#: Records of a staged file.
STAGED_RECORDS = 100_000


def topic_partition(key: Column, partitions: int = TOPIC_PARTITIONS) -> Column:
    """Keyed partitioning: one user's records always share a partition."""
    return F.pmod(F.hash(key), F.lit(partitions)).cast("int")


def to_records(messages: DataFrame, offset: str, partitions: int = TOPIC_PARTITIONS) -> DataFrame:
    """Messages (key, value) as records; `offset` orders one user's events."""
    return messages.select(
        "key", "value",
        topic_partition(F.col("key"), partitions).alias("partition"),
        F.col(offset).cast("bigint").alias("offset"),
    )


def publish_files(records: DataFrame, path: str) -> None:
    """Append records as Parquet files.  The stream partition is a column, so
    a hot user needs no shuffle and burdens no single task, nor does a large file."""
    records.select(*_COLUMNS).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(path)


def stage_batches(records: DataFrame, batch: str, path: str) -> None:
    """Write records as a folder a batch, neither shuffled nor sorted: a task keeps a file of each batch open, whose
    buffer is a row group, and none gets so large that one task would have much of a batch."""
    writer = records.write.option("maxRecordsPerFile", STAGED_RECORDS).option("parquet.block.size", ROW_GROUP)
    with settings(records.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_BATCHES)}):
        writer.partitionBy(batch).parquet(path, compression="zstd")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path)


def stream_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _as_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.lit(None).cast("string").alias("key"), "value", F.lit(0).alias("partition"),
        F.unix_micros("_metadata.file_modification_time").alias("offset"),
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("place"),
    )


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files with one raw event per line.  They carry no offsets, so the
    order is the file's modification time, then the place in the file."""
    return _as_lines(spark.read.text(path))


def stream_json_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _as_lines(reader.text(path))


def in_order(records: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """Records and the columns that order them.  Lines of a file block are
    numbered here, since a stream cannot number its rows before a batch."""
    if "place" not in records.columns:
        # A replayed dead letter of a text file brings its line along.
        return records, ("offset", "partition", *(["line"] if "line" in records.columns else []))
    return records.withColumn("line", F.monotonically_increasing_id()), ("offset", "place", "line")


def kafka_options(servers: str, topic: str = TOPIC, **extra: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, **extra}


def stream_options(servers: str, topic: str = TOPIC, records_per_trigger: int | None = None) -> dict[str, str]:
    extra = {"startingOffsets": "earliest", "failOnDataLoss": "true"}
    if records_per_trigger:
        extra["maxOffsetsPerTrigger"] = str(records_per_trigger)
    return kafka_options(servers, topic, **extra)


def stream_kafka(
    spark: SparkSession, servers: str, topic: str = TOPIC, records_per_trigger: int | None = None
) -> DataFrame:
    """The broker's topic from the earliest offset.  Needs the spark-sql-kafka
    package on the class path; offsets live in the checkpoint, so nothing is
    committed before the batch is written.

    A poll of the service takes MAX_RECORDS_PER_POLL records; a micro-batch
    amortizes its cost over far more, so there is no limit unless one is asked
    for, and that is passed on as it is.
    """
    options = stream_options(servers, topic, records_per_trigger)
    source = spark.readStream.format("kafka").options(**options).load()
    return source.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset"
    )


def publish_kafka(records: DataFrame, servers: str, topic: str = TOPIC) -> None:
    """Keyed publish to the broker, which partitions by key itself; all
    replicas must acknowledge."""
    (
        records.select("key", "value")
        .write.format("kafka")
        .options(**{
            "kafka.bootstrap.servers": servers,
            "topic": topic,
            "kafka.acks": "all",
            "kafka.enable.idempotence": "true",
            "kafka.linger.ms": "20",
            "kafka.batch.size": "65536",
        })
        .save()
    )


def publish_dead_letters(letters: DataFrame, servers: str, topic: str = TOPIC) -> None:
    """Also send refused records, raw, to the topic's dead-letter topic; the
    quarantine table stays the record of why they were refused."""
    publish_kafka(letters, servers, topic + DEAD_LETTER_SUFFIX)

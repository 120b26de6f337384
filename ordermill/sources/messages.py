"""Message sources: a Kafka topic, or any folder of Kafka-shaped rows."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from ordermill.schemas import DEFAULT_TOPIC, MESSAGE


@dataclass(frozen=True)
class KafkaTopic:
    """A topic read from its earliest offset; lost data is an error, topics are not created."""

    servers: str
    topic: str = DEFAULT_TOPIC
    max_per_batch: int = 1000

    def _options(self):
        return {
            "kafka.bootstrap.servers": self.servers,
            "subscribe": self.topic,
            "startingOffsets": "earliest",
            "kafka.allow.auto.create.topics": "false",
            "failOnDataLoss": "true",
        }

    def read(self, spark):
        return spark.read.format("kafka").options(**self._options()).load()

    def stream(self, spark):
        return (
            spark.readStream.format("kafka")
            .options(**self._options())
            .option("maxOffsetsPerTrigger", self.max_per_batch)
            .load()
        )


@dataclass(frozen=True)
class MessageFolder:
    """Parquet files of Kafka-shaped rows, taken in order of arrival."""

    path: str
    topic: str = DEFAULT_TOPIC
    max_per_batch: int = 1

    def read(self, spark):
        return spark.read.schema(MESSAGE).parquet(self.path)

    def stream(self, spark):
        return (
            spark.readStream.schema(MESSAGE)
            .option("maxFilesPerTrigger", self.max_per_batch)
            .parquet(self.path)
        )


def preview(spark, source, rows=1000):
    """A bounded sample of the retained messages; no order across partitions."""
    return source.read(spark).limit(rows)


def project_message(messages):
    return messages.select(
        "topic",
        "partition",
        "offset",
        "key",
        "value",
        F.unix_millis("timestamp").alias("kafka_timestamp_ms"),
    )


def json_stream(spark, folder, schema, max_files=None):
    """A folder of JSON lines as a stream with a declared schema."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)

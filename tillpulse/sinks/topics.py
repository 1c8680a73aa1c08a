"""Topic sink and raw log archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, functions as F
from pyspark.sql.streaming import DataStreamWriter


FILE_RECORDS = 500_000


def record_topics(writer: DataFrameWriter, folder: str) -> None:
    """Write records as the replay form of the topic source reads them."""
    writer.options(compression="gzip", maxRecordsPerFile=FILE_RECORDS).json(folder)


def topic_sink(
    df: DataFrame,
    checkpoint: str,
    *,
    producer: str = "sink",
    brokers: str | None = None,
    replay_dir: str | None = None,
) -> DataStreamWriter:
    """Send each row's ``value`` to its ``topic``: a Kafka broker, or folders that ``topic_source`` replays.

    Several jobs may feed one folder under different ``producer`` names; every batch has a folder of its
    own, which a repeated batch overwrites. Recorded topics are compressed, in files of at most ``FILE_RECORDS``: a compressed
    file is read by one task.
    """
    if (brokers is None) == (replay_dir is None):
        raise ValueError("give either brokers or replay_dir")
    if brokers is not None:
        writer = df.select("topic", "value").writeStream.format("kafka").option("kafka.bootstrap.servers", brokers)
    else:

        def record(batch: DataFrame, batch_id: int) -> None:
            record_topics(batch.write.mode("overwrite").partitionBy("topic"), f"{replay_dir}/{producer}-{batch_id}")

        writer = df.select("topic", "value", "arrival_ts").writeStream.foreachBatch(record)
    return writer.option("checkpointLocation", checkpoint).outputMode("append")


def archive_logs(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keep the raw lines, one folder per day of arrival."""
    lines = df.select("value", F.date_format("arrival_ts", "yyyy-MM-dd").alias("dt"))
    return (
        lines.writeStream.format("text")
        .partitionBy("dt")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )

"""Topic source: broker or replay folder to (value, arrival_ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Topic names are ours to choose; jobs take them as parameters.
STARTUP_TOPIC = "startup_log"
EVENT_TOPIC = "event_log"
ORDER_TOPIC = "new_order"
ORDER_DETAIL_TOPIC = "new_order_detail"
USER_TOPIC = "new_user"

REPLAY_SCHEMA = "value string, arrival_ts timestamp"


def topic_source(
    spark: SparkSession,
    topic: str,
    *,
    brokers: str | None = None,
    replay_dir: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A stream of one topic, from a Kafka broker or from the folder ``topic_sink`` writes to
    (``<folder>/<any name>/topic=<topic>``).

    The broker form starts at the latest offset unless told otherwise; offsets are kept in the
    query's checkpoint. It needs the Kafka connector package on the class path.
    """
    if (brokers is None) == (replay_dir is None):
        raise ValueError("give either brokers or replay_dir")
    if brokers is not None:
        reader = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("subscribe", topic)
            .option("startingOffsets", "latest")
        )
        for key, value in (options or {}).items():
            reader = reader.option(key, value)
        return reader.load().select(
            F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrival_ts")
        )
    reader = spark.readStream.schema(REPLAY_SCHEMA)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.json(f"{replay_dir}/*/topic={topic}")

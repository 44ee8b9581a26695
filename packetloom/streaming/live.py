"""Live views of packets that keep arriving: an extension beside the batch operators, with the same rules for what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.routing import retain_source_context, route_to_targets


def packet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Packets from Parquet files as they land in a folder, with an event time."""
    packets = spark.readStream.schema(schema).parquet(path)
    return packets.withColumn("event_time", F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("long")))


def quarter_hours(packets: DataFrame, late: str = "15 minutes") -> DataFrame:
    """Packets and bytes of each protocol in each quarter hour; a quarter hour is final when its lateness has passed."""
    window = F.window("event_time", "15 minutes")
    return (
        packets.withWatermark("event_time", late)
        .groupBy(window.alias("w"), "protocol")
        .agg(F.count("*").alias("packets"), F.sum("original_frame_length").alias("original_bytes"))
        .select(F.date_format("w.start", "yyyyMMddHHmm").alias("chunk_id"), "protocol", "packets", "original_bytes")
    )


def keep_observations(packets: DataFrame, cohort: DataFrame, root: str, checkpoint: str) -> list[StreamingQuery]:
    """Start two queries that append the kept packets of a fixed cohort below root; the cohort is a static table."""
    kept = {"target_packets": route_to_targets(packets, cohort), "source_context_packets": retain_source_context(packets, cohort)}
    return [
        df.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        for name, df in kept.items()
    ]

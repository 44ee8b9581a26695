"""Flows of one observation window: packets grouped by direction-independent key, without timeouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KEY, TCP, first_by, gapless_ids, plain_syn, with_key

#: Columns of a flow, in the order of files.
FLOW_COLUMNS = (
    "flow_id", "ip_version", "protocol", "start_time", "end_time", "duration", "src_ip", "src_port", "dst_ip", "dst_port",
    "packet_count", "captured_frame_bytes", "original_frame_bytes", "ip_bytes", "transport_payload_bytes",
    "initial_syn_sender_ip", "initial_syn_sender_port", "initial_syn_receiver_ip", "initial_syn_receiver_port",
)


def flow_table(packets: DataFrame, keys: bool = False) -> DataFrame:
    """One row for each key. First and last follow the order of capture (packet_index), not time; ids follow first packets.

    With `keys`, the key columns come too.
    """
    syn = (F.col("protocol") == TCP) & plain_syn(F.col("tcp_flags"))
    at = "packet_index"
    first = {c: first_by(c, at) for c in ("ip_version", "src_ip", "src_port", "dst_ip", "dst_port")}
    initial = {
        f"initial_syn_{role}_{part}": first_by(f"{side}_{part}", at, syn) for role, side in (("sender", "src"), ("receiver", "dst")) for part in ("ip", "port")
    }
    grouped = with_key(packets).groupBy(*KEY).agg(
        F.min(at).alias("__first"),
        first_by("timestamp", at).alias("start_time"),
        F.max_by("timestamp", at).alias("end_time"),
        F.count("*").alias("packet_count"),
        F.sum("captured_frame_length").alias("captured_frame_bytes"),
        F.sum("original_frame_length").alias("original_frame_bytes"),
        F.sum("ip_total_length").alias("ip_bytes"),
        F.sum("transport_payload_length").alias("transport_payload_bytes"),
        *[v.alias(k) for k, v in (first | initial).items()],
    )
    timed = grouped.withColumn("duration", F.col("end_time") - F.col("start_time"))
    numbered = gapless_ids(timed, "__first", "flow_id")
    return numbered.select(*FLOW_COLUMNS, *(KEY[:2] if keys else ()))


def flow_violations(flows: DataFrame) -> DataFrame:
    """One row of counts of rows that break a rule of flow facts; all are 0 for a valid table."""
    finite = lambda c: ~(F.isnan(c) | (F.abs(c) == float("inf")))
    partial = [F.col(f"initial_syn_{r}_ip").isNull() != F.col(f"initial_syn_{r}_port").isNull() for r in ("sender", "receiver")]
    twice = flows.groupBy("flow_id").count().where("count > 1").agg(F.count("*").alias("duplicate_ids"))
    times = [F.col(c) for c in ("start_time", "end_time", "duration")]
    counts = flows.agg(
        F.count_if((F.col("flow_id") <= 0) | (F.col("packet_count") <= 0)).alias("bad_ids_or_counts"),
        F.count_if(~F.col("protocol").isin(6, 17) | ~F.col("ip_version").isin(4, 6)).alias("bad_protocols"),
        F.count_if(~(finite(times[0]) & finite(times[1]) & finite(times[2])) | (times[2] != times[1] - times[0])).alias("bad_intervals"),
        F.count_if(partial[0] | partial[1]).alias("partial_syn"),
        F.count_if(~F.col("src_port").between(0, 65535) | ~F.col("dst_port").between(0, 65535)).alias("bad_ports"),
    )
    return counts.join(F.broadcast(twice))  # one row each

"""The cohort: flows seen with chosen packet counts, and the source whose context is wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import TCP, renamed

COHORT_COLUMNS = (
    "target_flow_id", "observed_packet_count", "ip_version", "protocol", "src_ip", "src_port", "dst_ip", "dst_port",
    "target_start_time", "target_end_time", "target_duration",
    "initial_syn_sender_ip", "initial_syn_sender_port", "initial_syn_receiver_ip", "initial_syn_receiver_port",
    "context_source_ip", "context_source_basis",
)
SYN_BASIS, FIRST_BASIS = "initial_syn_sender", "first_observed_src"
_NAMES = {
    "flow_id": "target_flow_id", "packet_count": "observed_packet_count",
    "start_time": "target_start_time", "end_time": "target_end_time", "duration": "target_duration",
}


def checked_counts(packet_counts: Sequence[int]) -> tuple[int, ...]:
    """Packet counts in order; they must be unique positive integers, at least one."""
    counts = list(packet_counts)
    if not counts or len({*counts}) != len(counts) or not all(type(n) is int and n > 0 for n in counts):
        raise ValueError("packet counts must be unique positive integers")
    return tuple(sorted(counts))


def with_context_source(flows: DataFrame) -> DataFrame:
    """TCP flows with an initial SYN take its sender, all others the first source."""
    by_syn = (F.col("protocol") == TCP) & F.col("initial_syn_sender_ip").isNotNull()
    return flows.withColumns(
        {
            "context_source_ip": F.when(by_syn, F.col("initial_syn_sender_ip")).otherwise(F.col("src_ip")),
            "context_source_basis": F.when(by_syn, SYN_BASIS).otherwise(FIRST_BASIS),
        }
    )


def select_cohort(flows: DataFrame, packet_counts: Sequence[int]) -> DataFrame:
    """Flows with one of the packet counts; further columns than a flow's (such as its key) stay."""
    chosen = with_context_source(flows.where(F.col("packet_count").isin(*checked_counts(packet_counts))))
    names = [_NAMES.get(c, c) for c in chosen.columns]
    more = [c for c in names if c not in COHORT_COLUMNS and not c.endswith("_bytes")]
    return renamed(chosen, _NAMES, [*COHORT_COLUMNS, *more])


def index_conflicts(cohort: DataFrame) -> DataFrame:
    """Keys with two ids and ids with two keys: (conflict, n), n the number of those."""
    key = F.struct("key_a", "key_b", "protocol")
    rows = cohort.select(key.alias("key"), "target_flow_id")
    keys = rows.groupBy("key").agg(F.count_distinct("target_flow_id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    ids = rows.groupBy("target_flow_id").agg(F.count_distinct("key").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    return keys.select(F.lit("key_with_ids").alias("conflict"), "n").unionByName(ids.select(F.lit("id_with_keys").alias("conflict"), "n"))


def reversed_intervals(cohort: DataFrame) -> DataFrame:
    """Flows whose interval ends before it starts: they cannot divide a day into before, inside and after."""
    return cohort.where("target_start_time > target_end_time").select("target_flow_id", "target_start_time", "target_end_time")

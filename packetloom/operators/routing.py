"""Which packets of a day are kept: those of cohort flows, and those about candidate sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import CONTROL, KEY, TCP, UDP, has, with_key

#: Lookup tables with up to so many rows are sent to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def sent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The table, marked for broadcast if it is known to be small."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def route_to_targets(packets: DataFrame, cohort: DataFrame, rows: int | None = None) -> DataFrame:
    """Packets of cohort flows, either direction, with their flow's id. The cohort has its key columns."""
    keys = cohort.select("target_flow_id", *KEY)
    keyed = packets if "key_a" in packets.columns else with_key(packets)
    return keyed.join(sent(keys, rows), list(KEY)).drop("key_a", "key_b")


def candidate_sources(cohort: DataFrame) -> DataFrame:
    """Sources of any protocol, once each."""
    return cohort.select("context_source_ip").distinct()


def retain_source_context(packets: DataFrame, cohort: DataFrame, rows: int | None = None) -> DataFrame:
    """TCP packets with FIN, SYN or RST from or to a candidate source, and UDP packets from one; each packet once.

    Membership is that of the exact address text, whatever protocol made it a candidate.
    """
    names = candidate_sources(cohort)
    source, target = (sent(names.select(F.col("context_source_ip").alias(c)), rows) for c in ("src_ip", "dst_ip"))
    wanted = packets.where((F.col("protocol") == UDP) | ((F.col("protocol") == TCP) & has(F.col("tcp_flags"), CONTROL)))
    outbound = wanted.join(source, "src_ip", "left_semi")
    inbound = wanted.where(F.col("protocol") == TCP).join(source, "src_ip", "left_anti").join(target, "dst_ip", "left_semi")
    return outbound.unionByName(inbound)


def expand_endpoints(source_packets: DataFrame) -> DataFrame:
    """A row for each endpoint whose context a packet is: its source, and for TCP its destination if that is another.

    A packet to its own source is one row that is outbound and inbound.
    """
    own = F.col("src_ip") == F.col("dst_ip")
    tcp = F.col("protocol") == TCP
    row = lambda ip, out, inn: F.struct(ip.alias("context_source_ip"), out.alias("outbound"), inn.alias("inbound"))
    src = row(F.col("src_ip"), F.lit(True), own)
    dst = row(F.col("dst_ip"), F.lit(False), F.lit(True))
    ends = F.when(tcp & ~own, F.array(src, dst)).otherwise(F.array(src))
    return source_packets.withColumn("__end", F.explode(ends)).select(*source_packets.columns, "__end.*")

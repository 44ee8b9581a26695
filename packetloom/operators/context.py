"""Context of cohort flows: their own tuple over the day, and their source over the day and in windows around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ACK, FIN, RST, SYN, TCP, UDP, has, plain_syn
from .cohort import COHORT_COLUMNS

NEIGHBOURHOODS = (1, 10, 60, 300)
WINDOWS = (60, 300)
#: Width of the time buckets that destinations are gathered by, in seconds; the narrowest window of a flow reaches over one's end.
BUCKET = 60

COHORT_RESULT_COLUMNS = tuple(c for c in COHORT_COLUMNS if not c.startswith("initial_syn_"))
TUPLE_COLUMNS = (
    "same_tuple_packet_count_24h", "same_tuple_before_count", "same_tuple_target_interval_count", "same_tuple_after_count",
    "previous_same_tuple_timestamp", "previous_same_tuple_gap_seconds", "next_same_tuple_timestamp", "next_same_tuple_gap_seconds",
    *(f"same_tuple_{side}_{n}s_count" for n in NEIGHBOURHOODS for side in ("before", "after")),
)
HORIZONS = ("24h", *(f"window_{n}s" for n in WINDOWS))
TCP_METRICS = (
    "tcp_control_packet_count", "tcp_outbound_plain_syn_count", "tcp_inbound_syn_ack_count", "tcp_outbound_rst_count", "tcp_inbound_rst_count",
    "tcp_outbound_fin_count", "tcp_inbound_fin_count", "tcp_outbound_unique_dst_ip_count", "tcp_outbound_unique_dst_port_count",
    "tcp_outbound_unique_dst_ip_port_count",
)
UDP_METRICS = ("udp_outbound_packet_count", "udp_outbound_unique_dst_ip_count", "udp_outbound_unique_dst_port_count", "udp_outbound_unique_dst_ip_port_count")
METRICS = {TCP: TCP_METRICS, UDP: UDP_METRICS}
RESULT_COLUMNS = (*COHORT_RESULT_COLUMNS, *TUPLE_COLUMNS, *(f"{m}_{h}" for p in (TCP, UDP) for h in HORIZONS for m in METRICS[p]))


def tuple_metrics(cohort: DataFrame, targets: DataFrame) -> DataFrame:
    """For each cohort flow, its packets of the day relative to its interval; neighbours that do not exist are null.

    `targets` has target_flow_id and timestamp of the day's packets of cohort flows.
    """
    flows = cohort.select("target_flow_id", "target_start_time", "target_end_time")
    t, start, end = F.col("timestamp"), F.col("target_start_time"), F.col("target_end_time")
    before, after = t < start, t > end
    aggregates = {
        "same_tuple_packet_count_24h": F.count(t),
        "same_tuple_before_count": F.count_if(before),
        "same_tuple_target_interval_count": F.count_if((t >= start) & (t <= end)),
        "same_tuple_after_count": F.count_if(after),
        "previous_same_tuple_timestamp": F.max(F.when(before, t)),
        "next_same_tuple_timestamp": F.min(F.when(after, t)),
    }
    for n in NEIGHBOURHOODS:
        aggregates[f"same_tuple_before_{n}s_count"] = F.count_if(before & (t >= start - n))
        aggregates[f"same_tuple_after_{n}s_count"] = F.count_if(after & (t <= end + n))
    joined = flows.join(targets.select("target_flow_id", "timestamp"), "target_flow_id", "left")
    found = joined.groupBy("target_flow_id", "target_start_time", "target_end_time").agg(*[v.alias(k) for k, v in aggregates.items()])
    gaps = {
        "previous_same_tuple_gap_seconds": start - F.col("previous_same_tuple_timestamp"),
        "next_same_tuple_gap_seconds": F.col("next_same_tuple_timestamp") - end,
    }
    return found.withColumns(gaps).select("target_flow_id", *TUPLE_COLUMNS)


#: What is counted of a source's packets, and in which order each protocol's columns take it.
_FLAGGED = {
    "plain_syn": lambda out, inn, flags: out & plain_syn(flags),
    "syn_ack": lambda out, inn, flags: inn & has(flags, SYN) & has(flags, ACK),
    "rst_out": lambda out, inn, flags: out & has(flags, RST),
    "rst_in": lambda out, inn, flags: inn & has(flags, RST),
    "fin_out": lambda out, inn, flags: out & has(flags, FIN),
    "fin_in": lambda out, inn, flags: inn & has(flags, FIN),
}
_SUMMED = ("packets", *_FLAGGED)
_UNIQUE = ("ips", "ports", "pairs")
_PARTS = {TCP: (*_SUMMED, *_UNIQUE), UDP: ("packets", *_UNIQUE)}
_SOURCE = ("context_source_ip", "protocol")
_DESTINATION = ("dst_ip", "dst_port")
_EVENT = (*_SOURCE, "timestamp", "tcp_flags", "outbound", "inbound", *_DESTINATION)


def _tests() -> dict[str, Column]:
    out, inn, flags = F.col("outbound"), F.col("inbound"), F.col("tcp_flags")
    return {"packets": F.lit(True)} | {k: f(out, inn, flags) for k, f in _FLAGGED.items()}


def _distinct(seen: dict[str, Column]) -> list[Column]:
    """Distinct counts as `<part>_<scope>`, from rows that are one for each destination; seen: where a scope has it."""
    out = []
    for scope, there in seen.items():
        values = (F.count_distinct(F.when(there, F.col("dst_ip"))), F.count_distinct(F.when(there, F.col("dst_port"))), F.count_if(there))
        out += [v.alias(f"{u}_{scope}") for u, v in zip(_UNIQUE, values, strict=True)]
    return out


def _day_counts(cohort: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Counts of each source and protocol of the cohort over the whole day (scope 24h), once for each source.

    Rows are first summed by destination, which a hot source repeats most; a distinct count then sees each destination once.
    """
    joined = cohort.select(*_SOURCE).distinct().join(endpoints.select(*_EVENT), list(_SOURCE), "left")
    there = F.col("timestamp").isNotNull()
    sums = [F.count_if(there & t).alias(f"{k}_24h") for k, t in _tests().items()]
    first = joined.groupBy(*_SOURCE, *_DESTINATION).agg(*sums, F.max(there & F.col("outbound")).alias("__seen"))
    return first.groupBy(*_SOURCE).agg(*[F.sum(f"{k}_24h").alias(f"{k}_24h") for k in _SUMMED], *_distinct({"24h": F.col("__seen")}))


def _window_sums(flows: DataFrame, events: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Packets of each flow's source within its windows, by kind, as differences of running sums; flows and packets do not meet.

    The edges of all windows are sorted among the source's packets, second by second, so that no source is one task's; what earlier
    seconds hold is added from a table of sums, which has a row for each second of a source at most.
    """
    edges = []
    for n in windows:
        edges += [(n, -1, F.col("target_start_time") - n), (n, 1, F.col("target_end_time") + n)]  # before packets of its time, and after
    edge = [F.struct(F.lit(n).alias("reach"), F.lit(side).alias("side"), at.alias("timestamp")) for n, side, at in edges]
    points = flows.select("target_flow_id", *_SOURCE, F.explode(F.array(*edge)).alias("edge")).select("target_flow_id", *_SOURCE, "edge.*", *[F.lit(0).alias(k) for k in _SUMMED])
    packets = events.select(
        F.lit(None).cast("long").alias("target_flow_id"), *_SOURCE, F.lit(None).cast("int").alias("reach"), F.lit(0).alias("side"), "timestamp", *[t.cast("int").alias(k) for k, t in _tests().items()]
    )
    rows = packets.unionByName(points).withColumn("second", F.floor("timestamp"))

    place = [*_SOURCE, "second"]
    so_far = Window.partitionBy(*place).orderBy("timestamp", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select("target_flow_id", *place, "reach", "side", *[F.sum(k).over(so_far).alias(k) for k in _SUMMED]).where("side <> 0")
    before = Window.partitionBy(*_SOURCE).orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    seconds = rows.groupBy(*place).agg(*[F.sum(k).alias(k) for k in _SUMMED])
    earlier = seconds.select(*place, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"earlier_{k}") for k in _SUMMED])

    values = {}
    for n in windows:
        for k in _SUMMED:
            signed = F.col("side") * (F.coalesce(k, F.lit(0)) + F.col(f"earlier_{k}"))
            # A window that ends before it starts has no packets.
            values[f"{k}_window_{n}s"] = F.greatest(F.sum(F.when(F.col("reach") == n, signed)), F.lit(0))
    return running.join(earlier, place).groupBy("target_flow_id").agg(*[v.alias(k) for k, v in values.items()])


def destinations(events: DataFrame) -> DataFrame:
    """(source, protocol, bucket, destination, first, last): when a source's packets of a bucket reached each destination."""
    reached = events.where("outbound").withColumn("bucket", _bucket(F.col("timestamp")))
    return reached.groupBy(*_SOURCE, "bucket", *_DESTINATION).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def _bucket(time: Column) -> Column:
    return F.floor(time / BUCKET)


def _window_unique(flows: DataFrame, events: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Distinct destinations of each flow's source within its windows, from the destinations of each bucket rather than from packets.

    A window that reaches over a bucket's end has its packets before or after some time there, so the first and last packet to a
    destination tell whether it has any. Windows within one bucket (of flows that end long before they start) see single packets.
    """
    edges = {n: (F.col("target_start_time") - n, F.col("target_end_time") + n) for n in windows}
    low, high = edges[max(windows)]
    probes = flows.where(_bucket(low) <= _bucket(high)).withColumn("bucket", F.explode(F.sequence(_bucket(low), _bucket(high))))
    within = F.lit(False)
    for a, b in edges.values():
        within = within | (_bucket(a) >= _bucket(b))
    single = events.where("outbound").select(*_SOURCE, _bucket(F.col("timestamp")).alias("bucket"), *_DESTINATION, F.col("timestamp").alias("first"), F.col("timestamp").alias("last"))
    met = probes.where(~within).join(destinations(events), [*_SOURCE, "bucket"]).unionByName(probes.where(within).join(single, [*_SOURCE, "bucket"]))
    seen = [F.max((F.col("first") <= b) & (F.col("last") >= a)).alias(f"__seen_{n}") for n, (a, b) in edges.items()]
    each = met.groupBy("target_flow_id", *_DESTINATION).agg(*seen)
    return each.groupBy("target_flow_id").agg(*_distinct({f"window_{n}s": F.col(f"__seen_{n}") for n in windows}))


def _window_counts(cohort: DataFrame, endpoints: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Counts of each flow's source around its interval (scopes window_Ns); distinct counts are null where there is nothing to count."""
    flows = cohort.select("target_flow_id", *_SOURCE, "target_start_time", "target_end_time")
    events = endpoints.select(*_EVENT).join(flows.select(*_SOURCE).distinct(), list(_SOURCE), "left_semi")
    return _window_sums(flows, events, windows).join(_window_unique(flows, events, windows), "target_flow_id", "left")


def _named(protocol: int, scope: str, suffix: str = "") -> list[Column]:
    parts = zip(METRICS[protocol], _PARTS[protocol], strict=True)
    return [F.coalesce(F.col(f"{part}_{scope}"), F.lit(0)).alias(f"{name}{suffix}") for name, part in parts]


def _of(protocol: int, df: DataFrame) -> DataFrame:
    return df.where(F.col("protocol") == protocol)


def source_day(cohort: DataFrame, endpoints: DataFrame, protocol: int) -> DataFrame:
    """Counts of each source of the protocol's cohort flows over the whole day."""
    return _day_counts(_of(protocol, cohort), endpoints).select("context_source_ip", *_named(protocol, "24h"))


def source_window(cohort: DataFrame, endpoints: DataFrame, protocol: int, seconds: int) -> DataFrame:
    """Counts of each cohort flow's source within `seconds` of its interval, the interval included; zeros where there is none."""
    flows = _of(protocol, cohort)
    found = flows.select("target_flow_id").join(_window_counts(flows, endpoints, (seconds,)), "target_flow_id", "left")
    return found.select("target_flow_id", *_named(protocol, f"window_{seconds}s"))


def context_table(cohort: DataFrame, targets: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The whole result: 13 columns of the cohort, 16 of the tuple, 42 of the source; counts of the other protocol are 0."""
    joined = (
        cohort.select(*COHORT_RESULT_COLUMNS)
        .join(tuple_metrics(cohort, targets), "target_flow_id", "left")
        .join(_day_counts(cohort, endpoints), ["context_source_ip", "protocol"], "left")
        .join(_window_counts(cohort, endpoints, WINDOWS), "target_flow_id", "left")
    )
    counts = []
    for p in (TCP, UDP):
        for h in HORIZONS:
            for name, part in zip(METRICS[p], _PARTS[p], strict=True):
                counts.append(F.when(F.col("protocol") == p, F.coalesce(F.col(f"{part}_{h}"), F.lit(0))).otherwise(0).alias(f"{name}_{h}"))
    return joined.select(*COHORT_RESULT_COLUMNS, *TUPLE_COLUMNS, *counts)

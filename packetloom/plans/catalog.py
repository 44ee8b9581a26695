"""Queries by name over the stand-in packets, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import decode_table
from ..functions.keys import KEY, TCP, UDP, with_key
from ..operators import cohort as co
from ..operators import context as cx
from ..operators import flows as fl
from ..operators import routing as ro
from . import standin
from .calendar import calendar
from .standin import COUNTS, TARGET_CHUNK

Query = Callable[[SparkSession, str], DataFrame]


# --- steps -----------------------------------------------------------------------------------------------


def _packets(spark: SparkSession, d: str) -> DataFrame:
    return standin.packets(spark, d)


def _target(spark: SparkSession, d: str) -> DataFrame:
    return _packets(spark, d).where(F.col("chunk") == TARGET_CHUNK)


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return fl.flow_table(_target(spark, d), keys=True)


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    return co.select_cohort(_flows(spark, d), COUNTS)


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return ro.route_to_targets(_packets(spark, d), _cohort(spark, d))


def _retained(spark: SparkSession, d: str) -> DataFrame:
    return ro.retain_source_context(_packets(spark, d), _cohort(spark, d))


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    return ro.expand_endpoints(_retained(spark, d))


def _tuple(*columns: str) -> Query:
    return lambda spark, d: cx.tuple_metrics(_cohort(spark, d), _routed(spark, d)).select("target_flow_id", *columns)


def _day(protocol: int) -> Query:
    return lambda spark, d: cx.source_day(_cohort(spark, d), _endpoints(spark, d), protocol)


def _window(protocol: int, seconds: int) -> Query:
    return lambda spark, d: cx.source_window(_cohort(spark, d), _endpoints(spark, d), protocol, seconds)


def context_result(spark: SparkSession, d: str) -> DataFrame:
    """The whole result. The cohort is kept, since every part of it starts there; a dataset has it as a table."""
    packets, cohort = _packets(spark, d), _cohort(spark, d).persist()
    endpoints = ro.expand_endpoints(ro.retain_source_context(packets, cohort))
    return cx.context_table(cohort, ro.route_to_targets(packets, cohort), endpoints)


_SYN_PORTS = ("initial_syn_sender_port", "initial_syn_receiver_port")
_PACKET = ("packet_index", "timestamp", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "tcp_flags")
_DECODED = ("ip_version", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "transport_payload_length", "tcp_flags")
_LENGTHS = ("captured_frame_length", "original_frame_length", "ip_total_length", "transport_payload_length")
_PARTITION, _NEIGHBOURS, _HORIZON = cx.TUPLE_COLUMNS[:4], cx.TUPLE_COLUMNS[4:8], cx.TUPLE_COLUMNS[8:]


def bidirectional_key(spark: SparkSession, d: str) -> DataFrame:
    keyed = with_key(_packets(spark, d))
    parts = {f"{e}_{p}": F.col(f"key_{e}.{p}") for e in "ab" for p in ("addr", "port")}
    return keyed.select("packet_index", "protocol", *[v.alias(k) for k, v in parts.items()])


def flow_counts(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).groupBy("packet_count").agg(F.count("*").alias("flows"))


def context_source(spark: SparkSession, d: str) -> DataFrame:
    return _cohort(spark, d).groupBy("protocol", "context_source_basis").agg(F.count("*").alias("flows"), F.count_distinct("context_source_ip").alias("sources"))


def context_by_packet_count(spark: SparkSession, d: str) -> DataFrame:
    sums = [F.sum(c).cast("long").alias(c) for c in cx.RESULT_COLUMNS if c.endswith(("_count", "_24h", "_60s", "_300s")) and c != "observed_packet_count"]
    return context_result(spark, d).groupBy("observed_packet_count").agg(F.count("*").alias("flows"), *sums)


def _conformance(cohort: DataFrame, routed: DataFrame, retained: DataFrame) -> DataFrame:
    """Rules that kept packets must meet, with the number of rows that break each."""
    again = ro.retain_source_context(retained, cohort)
    keys = cohort.select("target_flow_id", *KEY)
    wrong_key = with_key(routed).join(keys.withColumn("known", F.lit(True)), ["target_flow_id", *KEY], "left").agg(F.count_if(F.col("known").isNull()).alias("n"))
    bad_time = lambda df: df.agg(F.count_if(F.isnan("timestamp") | (F.abs("timestamp") == float("inf"))).alias("n"))
    checks = {
        "target_key_mismatch": wrong_key,
        "target_time_not_finite": bad_time(routed),
        "source_time_not_finite": bad_time(retained),
        "source_not_retained": retained.join(again.select("packet_index"), "packet_index", "left_anti").agg(F.count("*").alias("n")),
    }
    out = None
    for name, found in checks.items():
        row = found.select(F.lit(name).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def observation_conformance(spark: SparkSession, d: str) -> DataFrame:
    return _conformance(_cohort(spark, d), _routed(spark, d), _retained(spark, d))


# Damage, by rules that SQL can repeat: what validators must find.
_DAMAGED_FLOW = {
    "packet_count": ("flow_id % 11 = 0", "0"), "protocol": ("flow_id % 19 = 0", "99"), "duration": ("flow_id % 7 = 0", "duration + 1"),
    "initial_syn_sender_port": ("flow_id % 5 = 0", "NULL"), "dst_port": ("flow_id % 13 = 0", "70000"), "flow_id": ("flow_id % 17 = 0", "1"),
}
_DAMAGED_COHORT = {"target_start_time": ("target_flow_id % 6 = 0", "target_start_time + 1")}
_DAMAGED_INTERVAL = {"target_end_time": ("target_flow_id % 8 = 0", "target_start_time - 1")}
_DAMAGED_ROUTE = {"target_flow_id": ("packet_index % 10 = 0", "target_flow_id + 1"), "timestamp": ("packet_index % 12 = 0", "CAST('NaN' AS DOUBLE)")}
_DAMAGED_PACKET = {"timestamp": ("packet_index % 14 = 0", "CAST('Infinity' AS DOUBLE)")}


def _cases(rules: dict[str, tuple[str, str]]) -> dict[str, str]:
    return {c: f"CASE WHEN {when} THEN {value} ELSE {c} END" for c, (when, value) in rules.items()}


def _damaged(df: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({c: F.expr(case) for c, case in _cases(rules).items()})


def _damaged_sql(rules: dict[str, tuple[str, str]], table: str) -> str:
    return f"(SELECT * REPLACE ({', '.join(f'{case} AS {c}' for c, case in _cases(rules).items())}) FROM {table})"


def conformance_damaged(spark: SparkSession, d: str) -> DataFrame:
    """The rules over packets of wrong flows, times that are not finite, and packets that should not have been kept."""
    stray = _packets(spark, d).where("packet_index % 50 = 0")
    retained = _retained(spark, d)
    return _conformance(_cohort(spark, d), _damaged(_routed(spark, d), _DAMAGED_ROUTE), _damaged(retained.unionByName(stray.select(*retained.columns)), _DAMAGED_PACKET))


def conflicts_damaged(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts where some ids are one and some keys have a further id."""
    rows = _cohort(spark, d).select("target_flow_id", *KEY)
    merged = rows.withColumn("target_flow_id", F.expr("target_flow_id - target_flow_id % 4"))
    return co.index_conflicts(merged.unionByName(rows.where("target_flow_id % 9 = 0").withColumn("target_flow_id", F.expr("target_flow_id + 1000000"))))


def cohort_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which a stored cohort (damaged here: rows are lost, times changed) and one computed anew differ, counted on either side."""
    again = _cohort(spark, d).select(*co.COHORT_COLUMNS)
    stored = _damaged(again.where("target_flow_id % 10 <> 0"), _DAMAGED_COHORT)
    counted = lambda df, n: df.groupBy(*co.COHORT_COLUMNS).agg(F.count("*").alias(n))
    a, b = counted(stored, "na").alias("a"), counted(again, "nb").alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in co.COHORT_COLUMNS]
    joined = a.join(b, same, "full")
    return joined.agg(F.count_if(F.coalesce("na", F.lit(0)) != F.coalesce("nb", F.lit(0))).alias("differences"), F.count("*").alias("rows"))


def _varied(spark: SparkSession, d: str) -> DataFrame:
    return decode_table(standin.varied_frames(_packets(spark, d)))


def _ports_as_text(df: DataFrame) -> DataFrame:
    """Nullable ports as text, which every reader shows alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in _SYN_PORTS})


QUERIES: dict[str, Query] = {
    "chunk_calendar": lambda spark, d: calendar(spark, standin.DAY),
    "bidirectional_key": bidirectional_key,
    "packet_decode": lambda spark, d: decode_table(standin.frames(_packets(spark, d))).where("skip_reason is null").select("packet_index", *_DECODED),
    "skip_counts": lambda spark, d: decode_table(standin.frames(_packets(spark, d))).where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n")),
    "packet_decode_varied": lambda spark, d: _varied(spark, d).where("skip_reason is null").select("packet_index", "ip_total_length", *_DECODED),
    "skip_counts_varied": lambda spark, d: _varied(spark, d).where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n")),
    "flow_table": lambda spark, d: fl.flow_table(_target(spark, d)).select(*(c for c in fl.FLOW_COLUMNS if not c.startswith("initial_syn"))),
    "flow_initial_syn": lambda spark, d: _ports_as_text(fl.flow_table(_target(spark, d)).select("flow_id", *fl.FLOW_COLUMNS[15:])),
    "flow_counts": flow_counts,
    "flow_validation": lambda spark, d: fl.flow_violations(fl.flow_table(_target(spark, d))),
    "flow_validation_damaged": lambda spark, d: fl.flow_violations(_damaged(fl.flow_table(_target(spark, d)), _DAMAGED_FLOW)),
    "cohort_select": lambda spark, d: _ports_as_text(_cohort(spark, d).select(*co.COHORT_COLUMNS)),
    "context_source": context_source,
    "index_conflicts": lambda spark, d: co.index_conflicts(_cohort(spark, d)),
    "reversed_interval_check": lambda spark, d: co.reversed_intervals(_cohort(spark, d)),
    "reversed_interval_damaged": lambda spark, d: co.reversed_intervals(_damaged(_cohort(spark, d), _DAMAGED_INTERVAL)),
    "index_conflicts_damaged": conflicts_damaged,
    "cohort_recomputed": cohort_recomputed,
    "target_routing": lambda spark, d: _routed(spark, d).select("target_flow_id", *_PACKET, *_LENGTHS),
    "source_retention_tcp": lambda spark, d: _retained(spark, d).where(F.col("protocol") == TCP).select(*_PACKET, *_LENGTHS),
    "source_retention_udp": lambda spark, d: _retained(spark, d).where(F.col("protocol") == UDP).select(*_PACKET, *_LENGTHS),
    "distinct_sources": lambda spark, d: ro.candidate_sources(_cohort(spark, d)),
    "endpoint_expansion": lambda spark, d: _endpoints(spark, d).select("packet_index", "protocol", "context_source_ip", "outbound", "inbound"),
    "observation_conformance": observation_conformance,
    "observation_conformance_damaged": conformance_damaged,
    "tuple_partition_counts": _tuple(*_PARTITION),
    "tuple_neighbors": _tuple(*_NEIGHBOURS),
    "tuple_horizon_counts": _tuple(*_HORIZON),
    "tcp_source_24h": _day(TCP),
    "tcp_source_60s": _window(TCP, 60),
    "tcp_source_300s": _window(TCP, 300),
    "udp_source_24h": _day(UDP),
    "udp_source_60s": _window(UDP, 60),
    "udp_source_300s": _window(UDP, 300),
    "context_result": context_result,
    "context_by_packet_count": context_by_packet_count,
}


# --- the same in SQL -------------------------------------------------------------------------------------

_STEPS = f"""
WITH {standin.PACKETS_SQL},
keyed AS (
  SELECT *, least((src_addr, src_port), (dst_addr, dst_port)) AS key_a, greatest((src_addr, src_port), (dst_addr, dst_port)) AS key_b FROM packets
),
grouped AS (
  SELECT key_a, key_b, protocol, min(packet_index) AS first_index, arg_min(ip_version, packet_index) AS ip_version,
         arg_min(timestamp, packet_index) AS start_time, arg_max(timestamp, packet_index) AS end_time,
         arg_min(src_ip, packet_index) AS src_ip, arg_min(src_port, packet_index) AS src_port,
         arg_min(dst_ip, packet_index) AS dst_ip, arg_min(dst_port, packet_index) AS dst_port,
         count(*) AS packet_count, CAST(sum(captured_frame_length) AS BIGINT) AS captured_frame_bytes,
         CAST(sum(original_frame_length) AS BIGINT) AS original_frame_bytes, CAST(sum(ip_total_length) AS BIGINT) AS ip_bytes,
         CAST(sum(transport_payload_length) AS BIGINT) AS transport_payload_bytes,
         arg_min(src_ip, packet_index) FILTER (syn) AS initial_syn_sender_ip, arg_min(src_port, packet_index) FILTER (syn) AS initial_syn_sender_port,
         arg_min(dst_ip, packet_index) FILTER (syn) AS initial_syn_receiver_ip, arg_min(dst_port, packet_index) FILTER (syn) AS initial_syn_receiver_port
  FROM (SELECT *, protocol = 6 AND (tcp_flags & 2) != 0 AND (tcp_flags & 16) = 0 AS syn FROM keyed WHERE chunk = {TARGET_CHUNK})
  GROUP BY key_a, key_b, protocol
),
flows AS (SELECT *, row_number() OVER (ORDER BY first_index) AS flow_id, end_time - start_time AS duration FROM grouped),
cohort AS (
  SELECT flow_id AS target_flow_id, packet_count AS observed_packet_count, start_time AS target_start_time, end_time AS target_end_time,
         duration AS target_duration, * EXCLUDE (flow_id, packet_count, start_time, end_time, duration),
         CASE WHEN protocol = 6 AND initial_syn_sender_ip IS NOT NULL THEN initial_syn_sender_ip ELSE src_ip END AS context_source_ip,
         CASE WHEN protocol = 6 AND initial_syn_sender_ip IS NOT NULL THEN 'initial_syn_sender' ELSE 'first_observed_src' END AS context_source_basis
  FROM flows WHERE packet_count IN {COUNTS}
),
routed AS (SELECT c.target_flow_id, p.* FROM keyed p JOIN cohort c USING (key_a, key_b, protocol)),
sources AS (SELECT DISTINCT context_source_ip AS ip FROM cohort),
retained AS (
  SELECT * FROM packets
  WHERE (protocol = 17 AND src_ip IN (FROM sources))
     OR (protocol = 6 AND (tcp_flags & 7) != 0 AND (src_ip IN (FROM sources) OR dst_ip IN (FROM sources)))
),
endpoints AS (
  SELECT *, src_ip AS context_source_ip, true AS outbound, src_ip = dst_ip AS inbound FROM retained
  UNION ALL
  SELECT *, dst_ip AS context_source_ip, false AS outbound, true AS inbound FROM retained WHERE protocol = 6 AND src_ip != dst_ip
)"""

_T, _S, _E = "o.timestamp", "c.target_start_time", "c.target_end_time"
_TUPLE_SQL = {
    "same_tuple_packet_count_24h": f"count({_T})",
    "same_tuple_before_count": f"count(*) FILTER ({_T} < {_S})",
    "same_tuple_target_interval_count": f"count(*) FILTER ({_T} >= {_S} AND {_T} <= {_E})",
    "same_tuple_after_count": f"count(*) FILTER ({_T} > {_E})",
    "previous_same_tuple_timestamp": f"max({_T}) FILTER ({_T} < {_S})",
    "previous_same_tuple_gap_seconds": f"{_S} - max({_T}) FILTER ({_T} < {_S})",
    "next_same_tuple_timestamp": f"min({_T}) FILTER ({_T} > {_E})",
    "next_same_tuple_gap_seconds": f"min({_T}) FILTER ({_T} > {_E}) - {_E}",
}
for _n in cx.NEIGHBOURHOODS:
    _TUPLE_SQL[f"same_tuple_before_{_n}s_count"] = f"count(*) FILTER ({_T} < {_S} AND {_T} >= {_S} - {_n})"
    _TUPLE_SQL[f"same_tuple_after_{_n}s_count"] = f"count(*) FILTER ({_T} > {_E} AND {_T} <= {_E} + {_n})"


def _tuple_sql(columns: tuple[str, ...]) -> str:
    values = ", ".join(f"{_TUPLE_SQL[c]} AS {c}" for c in columns)
    return f"SELECT c.target_flow_id, {values} FROM cohort c LEFT JOIN routed o USING (target_flow_id) GROUP BY c.target_flow_id, {_S}, {_E}"


def _source_sql(protocol: int, suffix: str = "") -> str:
    flag = lambda bit, on=True: f"(o.tcp_flags & {bit}) {'!=' if on else '='} 0"
    values = ["count(o.timestamp)"]
    if protocol == TCP:
        tests = (f"outbound AND {flag(2)} AND {flag(16, False)}", f"inbound AND {flag(2)} AND {flag(16)}", f"outbound AND {flag(4)}", f"inbound AND {flag(4)}", f"outbound AND {flag(1)}", f"inbound AND {flag(1)}")
        values += [f"count(*) FILTER ({t})" for t in tests]
    values += [f"count(DISTINCT {x}) FILTER (outbound)" for x in ("o.dst_ip", "o.dst_port", "(o.dst_ip, o.dst_port)")]
    return ", ".join(f"{v} AS {name}{suffix}" for v, name in zip(values, cx.METRICS[protocol], strict=True))


def _day_sql(protocol: int, suffix: str = "") -> str:
    return f"""SELECT c.context_source_ip, {_source_sql(protocol, suffix)}
FROM (SELECT DISTINCT context_source_ip FROM cohort WHERE protocol = {protocol}) c
LEFT JOIN endpoints o ON o.protocol = {protocol} AND o.context_source_ip = c.context_source_ip GROUP BY c.context_source_ip"""


def _window_sql(protocol: int, n: int, suffix: str = "") -> str:
    return f"""SELECT c.target_flow_id, {_source_sql(protocol, suffix)}
FROM cohort c LEFT JOIN endpoints o ON o.protocol = {protocol} AND o.context_source_ip = c.context_source_ip
  AND o.timestamp >= {_S} - {n} AND o.timestamp <= {_E} + {n}
WHERE c.protocol = {protocol} GROUP BY c.target_flow_id"""


def _context_sql() -> str:
    parts = [f"tuples AS ({_tuple_sql(cx.TUPLE_COLUMNS)})"]
    joins, fields = ["LEFT JOIN tuples USING (target_flow_id)"], [f"c.{c}" for c in cx.COHORT_RESULT_COLUMNS] + list(cx.TUPLE_COLUMNS)
    for p in (TCP, UDP):
        for h, n in zip(cx.HORIZONS, (None, *cx.WINDOWS), strict=True):
            name, key = f"s{p}_{h}", "context_source_ip" if n is None else "target_flow_id"
            parts.append(f"{name} AS ({_day_sql(p, '_' + h) if n is None else _window_sql(p, n, '_' + h)})")
            joins.append(f"LEFT JOIN {name} ON {name}.{key} = c.{key} AND c.protocol = {p}")
            fields += [f"coalesce({m}_{h}, 0) AS {m}_{h}" for m in cx.METRICS[p]]
    return f", {', '.join(parts)} SELECT {', '.join(fields)} FROM cohort c {' '.join(joins)}"


def _flow_rules_sql(table: str) -> str:
    return f"""SELECT count(*) FILTER (flow_id <= 0 OR packet_count <= 0) AS bad_ids_or_counts, count(*) FILTER (protocol NOT IN (6, 17) OR ip_version NOT IN (4, 6)) AS bad_protocols,
count(*) FILTER (NOT (isfinite(start_time) AND isfinite(end_time) AND isfinite(duration)) OR duration != end_time - start_time) AS bad_intervals,
count(*) FILTER ((initial_syn_sender_ip IS NULL) != (initial_syn_sender_port IS NULL) OR (initial_syn_receiver_ip IS NULL) != (initial_syn_receiver_port IS NULL)) AS partial_syn,
count(*) FILTER (src_port NOT BETWEEN 0 AND 65535 OR dst_port NOT BETWEEN 0 AND 65535) AS bad_ports,
(SELECT count(*) FROM (SELECT 1 FROM {table} GROUP BY flow_id HAVING count(*) > 1)) AS duplicate_ids FROM {table}"""


def _conflicts_sql(table: str) -> str:
    return f"""SELECT 'key_with_ids' AS conflict, count(*) AS n FROM (SELECT 1 FROM {table} GROUP BY key_a, key_b, protocol HAVING count(DISTINCT target_flow_id) > 1)
UNION ALL SELECT 'id_with_keys', count(*) FROM (SELECT 1 FROM {table} GROUP BY target_flow_id HAVING count(DISTINCT (key_a, key_b, protocol)) > 1)"""


def _reversed_sql(table: str) -> str:
    return f"SELECT target_flow_id, target_start_time, target_end_time FROM {table} WHERE target_start_time > target_end_time"


def _conformance_sql(routed: str, retained: str) -> str:
    return f"""SELECT 'target_key_mismatch' AS rule, count(*) FILTER (c.target_flow_id IS NULL) AS n FROM {routed} r LEFT JOIN cohort c USING (target_flow_id, key_a, key_b, protocol)
UNION ALL SELECT 'target_time_not_finite', count(*) FILTER (NOT isfinite(timestamp)) FROM {routed} UNION ALL SELECT 'source_time_not_finite', count(*) FILTER (NOT isfinite(timestamp)) FROM {retained}
UNION ALL SELECT 'source_not_retained', count(*) FROM {retained} WHERE NOT ((protocol = 17 AND src_ip IN (FROM sources))
OR (protocol = 6 AND (tcp_flags & 7) != 0 AND (src_ip IN (FROM sources) OR dst_ip IN (FROM sources))))"""


_six = lambda c: f"CASE WHEN {standin.SIX_SQL} THEN '2001:db8::' || format('{{:x}}', {c}_addr) ELSE {c}_ip END AS {c}_ip"
_VARIED_SQL = f"""SELECT packet_index, CASE WHEN {standin.SIX_SQL} THEN 40 ELSE 20 END + {standin.EXTRA_SQL} + CASE protocol WHEN 6 THEN 20 ELSE 8 END + transport_payload_length AS ip_total_length,
CASE WHEN {standin.SIX_SQL} THEN 6 ELSE 4 END AS ip_version, protocol, {_six('src')}, src_port, {_six('dst')}, dst_port, transport_payload_length, tcp_flags
FROM packets WHERE {standin.VARIED_SQL} IS NULL"""

_FLOW_FIELDS = ", ".join(c for c in fl.FLOW_COLUMNS if not c.startswith("initial_syn"))
_SUMMED = [c for c in cx.RESULT_COLUMNS if c.endswith(("_count", "_24h", "_60s", "_300s")) and c != "observed_packet_count"]
_text = lambda columns: ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c in _SYN_PORTS else c for c in columns)
_PACKET_FIELDS = ", ".join((*_PACKET, *_LENGTHS))

ORACLE_SQL: dict[str, str] = {
    "chunk_calendar": f"""SELECT CAST(k AS INT) AS chunk, strftime(TIMESTAMP '{standin.DAY}' + to_minutes(CAST(15 * k AS INT)), '%Y%m%d%H%M') AS chunk_id,
CAST({standin.BASE_US // 1_000_000} + 900 * k AS BIGINT) AS start_time FROM range(96) r(k)""",
    **{
        name: f"{_STEPS} {sql}"
        for name, sql in {
            "bidirectional_key": "SELECT packet_index, protocol, key_a[1] AS a_addr, key_a[2] AS a_port, key_b[1] AS b_addr, key_b[2] AS b_port FROM keyed",
            "packet_decode": f"SELECT packet_index, {', '.join(_DECODED)} FROM packets WHERE {standin.SKIPS_SQL} IS NULL",
            "skip_counts": f"SELECT {standin.SKIPS_SQL} AS skip_reason, count(*) AS n FROM packets WHERE {standin.SKIPS_SQL} IS NOT NULL GROUP BY 1",
            "packet_decode_varied": _VARIED_SQL,
            "skip_counts_varied": f"SELECT {standin.VARIED_SQL} AS skip_reason, count(*) AS n FROM packets WHERE {standin.VARIED_SQL} IS NOT NULL GROUP BY 1",
            "flow_table": f"SELECT {_FLOW_FIELDS} FROM flows",
            "flow_initial_syn": f"SELECT flow_id, {_text(fl.FLOW_COLUMNS[15:])} FROM flows",
            "flow_counts": "SELECT packet_count, count(*) AS flows FROM flows GROUP BY packet_count",
            "flow_validation": _flow_rules_sql("flows"),
            "flow_validation_damaged": _flow_rules_sql(_damaged_sql(_DAMAGED_FLOW, "flows")),
            "cohort_select": f"SELECT {_text(co.COHORT_COLUMNS)} FROM cohort",
            "context_source": "SELECT protocol, context_source_basis, count(*) AS flows, count(DISTINCT context_source_ip) AS sources FROM cohort GROUP BY ALL",
            "index_conflicts": _conflicts_sql("cohort"),
            "index_conflicts_damaged": _conflicts_sql(
                "(SELECT target_flow_id - target_flow_id % 4 AS target_flow_id, key_a, key_b, protocol FROM cohort "
                "UNION ALL SELECT target_flow_id + 1000000, key_a, key_b, protocol FROM cohort WHERE target_flow_id % 9 = 0)"
            ),
            "reversed_interval_check": _reversed_sql("cohort"),
            "reversed_interval_damaged": _reversed_sql(_damaged_sql(_DAMAGED_INTERVAL, "cohort")),
            "cohort_recomputed": f"SELECT count(*) FILTER (na != nb) AS differences, count(*) AS rows FROM (SELECT {', '.join(co.COHORT_COLUMNS)}, sum(a) AS na, sum(b) AS nb "
            f"FROM (SELECT {', '.join(co.COHORT_COLUMNS)}, 1 AS a, 0 AS b FROM {_damaged_sql(_DAMAGED_COHORT, '(FROM cohort WHERE target_flow_id % 10 != 0)')} "
            f"UNION ALL SELECT {', '.join(co.COHORT_COLUMNS)}, 0, 1 FROM cohort) GROUP BY {', '.join(co.COHORT_COLUMNS)})",
            "target_routing": f"SELECT target_flow_id, {_PACKET_FIELDS} FROM routed",
            "source_retention_tcp": f"SELECT {_PACKET_FIELDS} FROM retained WHERE protocol = 6",
            "source_retention_udp": f"SELECT {_PACKET_FIELDS} FROM retained WHERE protocol = 17",
            "distinct_sources": "SELECT ip AS context_source_ip FROM sources",
            "endpoint_expansion": "SELECT packet_index, protocol, context_source_ip, outbound, inbound FROM endpoints",
            "observation_conformance": _conformance_sql("routed", "retained"),
            "observation_conformance_damaged": _conformance_sql(
                _damaged_sql(_DAMAGED_ROUTE, "routed"), _damaged_sql(_DAMAGED_PACKET, "(FROM retained UNION ALL FROM packets WHERE packet_index % 50 = 0)")
            ),
            "tuple_partition_counts": _tuple_sql(_PARTITION),
            "tuple_neighbors": _tuple_sql(_NEIGHBOURS),
            "tuple_horizon_counts": _tuple_sql(_HORIZON),
            "tcp_source_24h": _day_sql(TCP),
            "tcp_source_60s": _window_sql(TCP, 60),
            "tcp_source_300s": _window_sql(TCP, 300),
            "udp_source_24h": _day_sql(UDP),
            "udp_source_60s": _window_sql(UDP, 60),
            "udp_source_300s": _window_sql(UDP, 300),
            "context_result": _context_sql(),
            "context_by_packet_count": f"{_context_sql().rsplit(' SELECT c.target_flow_id', 1)[0]}, result AS (SELECT c.target_flow_id{_context_sql().rsplit(' SELECT c.target_flow_id', 1)[1]}) "
            f"SELECT observed_packet_count, count(*) AS flows, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMMED)} FROM result GROUP BY observed_packet_count",
        }.items()
    },
}

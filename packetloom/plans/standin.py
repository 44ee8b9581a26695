"""A day of packets made from the driver's `events` table: thirty days pressed into one, so that chunks and windows keep their meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_US = 1704067200000000
SQUEEZE = 30
CHUNK_US = 900_000_000
TARGET_CHUNK = 56
DAY = "2024-01-01"
COUNTS = (1, 2, 3)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded packets (see SQL below for the same in another dialect)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    squeezed = (F.lit(BASE_US) + F.expr(f"(__us - {BASE_US}) div {SQUEEZE}")).alias("u")
    e = e.select("event_id", "user_id", "event_type", k.alias("k"), us.alias("__us")).select("*", squeezed)
    even, own = F.col("event_id") % 2 == 0, F.col("event_id") % 97 == 0
    cl = F.lit(1000) + F.when(F.col("user_id") % 3 == 0, F.col("user_id") % 4).otherwise(10 + F.col("user_id") % 50)
    sv, port = F.lit(2000) + F.col("k") % 3, F.lit(80) + F.expr("(k div 3) % 2")
    src, dst = F.when(own | even, cl).otherwise(sv), F.when(even, sv).otherwise(cl)
    flags = F.when(F.col("event_id") % 3 == 0, 0)
    for kind, value in (("signup", 2), ("click", 18), ("error", 4), ("purchase", 17)):
        flags = flags.when(F.col("event_type") == kind, value)
    address = lambda c: F.concat_ws(".", F.lit("10.0"), F.expr(f"{c} div 256"), F.col(c) % 256)
    e = e.withColumns({"src_addr": src.cast("long"), "dst_addr": dst.cast("long")})
    original = F.lit(60) + 10 * F.col("k")
    return e.select(
        F.expr(f"(u - {BASE_US}) div {CHUNK_US}").cast("int").alias("chunk"),
        (F.col("event_id") + 1).alias("packet_index"),
        (F.col("u") / 1e6).alias("timestamp"),
        F.lit(4).alias("ip_version"),
        F.when(F.col("event_id") % 3 == 0, 17).otherwise(6).alias("protocol"),
        "src_addr",
        address("src_addr").alias("src_ip"),
        F.when(even, 40000).otherwise(port).cast("int").alias("src_port"),
        "dst_addr",
        address("dst_addr").alias("dst_ip"),
        F.when(even, port).otherwise(40000).cast("int").alias("dst_port"),
        F.least(original, F.lit(96)).cast("long").alias("captured_frame_length"),
        original.cast("long").alias("original_frame_length"),
        (original - 14).cast("long").alias("ip_total_length"),
        (F.col("k") * 10).cast("long").alias("transport_payload_length"),
        flags.otherwise(16).cast("int").alias("tcp_flags"),
    )


def frames(packets: DataFrame) -> DataFrame:
    """Ethernet frames of the packets, cut after the transport header; some are made undecodable (see SKIPS_SQL)."""
    number = lambda c, size: F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    tcp = F.col("protocol") == 6
    header = F.when(tcp, 20).otherwise(8)
    total = 20 + header + F.col("transport_payload_length")
    address = lambda c: F.concat(F.lit("0A00"), number(F.col(c), 2))
    arp, fragment, icmp = (F.col("packet_index") % n == 0 for n in (53, 51, 50))
    ports = F.concat(number(F.col("src_port"), 2), number(F.col("dst_port"), 2))
    body = F.when(tcp, F.concat(ports, F.lit("00" * 8 + "50"), number(F.col("tcp_flags"), 1), F.lit("00" * 6))).otherwise(
        F.concat(ports, number(8 + F.col("transport_payload_length"), 2), F.lit("0000"))
    )
    text = F.concat(
        F.lit("00" * 12), F.when(arp, "0806").otherwise("0800"), F.lit("4500"), number(total, 2), F.lit("0000"), F.when(fragment, "2000").otherwise("4000"), F.lit("40"),
        F.when(icmp, "01").otherwise(number(F.col("protocol"), 1)), F.lit("0000"), address("src_addr"), address("dst_addr"), body,
    )
    return packets.select("packet_index", F.unhex(text).alias("frame"), (34 + header).cast("long").alias("captured_frame_length"), (14 + total).alias("original_frame_length"))


def varied_frames(packets: DataFrame) -> DataFrame:
    """Frames with tags, IPv6, extension headers and the damage of VARIED_SQL, by packet_index modulo 16."""
    number = lambda c, size: F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    kind = F.col("packet_index") % 16
    tcp, six = F.col("protocol") == 6, kind.isin(2, 3, 4, 5, 6, 7, 11)
    proto, payload = number(F.col("protocol"), 1), F.col("transport_payload_length")
    header = F.when(tcp, 20).otherwise(8)
    tags = F.when(kind == 0, "81000001").when(kind == 1, "88A8000181000002").otherwise("")
    # Hop-by-hop and destination options; fragments; authentication headers.
    following = F.when(kind == 3, "00").when(kind.isin(4, 5), "2C").when(kind.isin(6, 7), "33").otherwise(proto)
    more = F.when(kind == 3, F.concat(F.lit("3C00" + "00" * 6), proto, F.lit("01" + "00" * 14)))
    more = more.when(kind == 4, F.concat(proto, F.lit("00" + "0008" + "00" * 4))).when(kind == 5, F.concat(proto, F.lit("00" + "0000" + "00" * 4)))
    more = more.when(kind == 6, F.concat(proto, F.lit("02" + "00" * 14))).when(kind == 7, F.concat(proto, F.lit("00" + "00" * 6))).otherwise("")
    inner = F.length(more) / 2 + header + payload
    wide = lambda c: F.concat(F.lit("20010DB8" + "00" * 8), number(F.col(c), 4))
    ipv6 = F.concat(F.lit("60000000"), number(inner + F.when(kind == 11, 1000).otherwise(0), 2), following, F.lit("40"), wide("src_addr"), wide("dst_addr"), more)
    first = F.when(kind == 8, "65").when(kind == 9, "44").when(kind == 15, "46").otherwise("45")
    options = F.when(kind == 15, "00" * 4).otherwise("")
    total = 20 + F.length(options) / 2 + header + payload
    declared = F.when(kind == 10, total + 1000).when(kind == 14, 24).otherwise(total)
    address = lambda c: F.concat(F.lit("0A00"), number(F.col(c), 2))
    ipv4 = F.concat(first, F.lit("00"), number(declared, 2), F.lit("0000400040"), proto, F.lit("0000"), address("src_addr"), address("dst_addr"), options)
    ports = F.concat(number(F.col("src_port"), 2), number(F.col("dst_port"), 2))
    short = kind == 12
    body = F.when(tcp, F.concat(ports, F.lit("00" * 8), F.when(short, "40").otherwise("50"), number(F.col("tcp_flags"), 1), F.lit("00" * 6))).otherwise(
        F.concat(ports, number(F.when(short, 7).otherwise(8 + payload), 2), F.lit("0000"))
    )
    text = F.concat(F.lit("00" * 12), tags, F.when(six, "86DD").otherwise("0800"), F.when(six, ipv6).otherwise(ipv4), body)
    text = F.when(kind == 13, F.substring(text, 1, 60)).otherwise(text)
    original = 14 + F.length(tags) / 2 + F.when(six, 40 + inner).otherwise(total)
    return packets.select("packet_index", F.unhex(text).alias("frame"), (F.length(text) / 2).cast("long").alias("captured_frame_length"), original.cast("long").alias("original_frame_length"))


#: Kinds of frames that cannot be decoded; all other kinds can.
VARIED_SQL = """CASE packet_index % 16 WHEN 4 THEN 'ip_fragment' WHEN 7 THEN 'malformed_ipv6_authentication_header_length' WHEN 8 THEN 'ethernet_ip_version_mismatch'
WHEN 9 THEN 'malformed_ipv4_length' WHEN 10 THEN 'ipv4_length_exceeds_original_frame_length' WHEN 11 THEN 'ipv6_length_exceeds_original_frame_length'
WHEN 12 THEN CASE protocol WHEN 6 THEN 'malformed_tcp_header_length' ELSE 'malformed_udp_length' END WHEN 13 THEN 'capture_truncated_undecodable'
WHEN 14 THEN 'packet_header_exceeds_declared_length' END"""
SIX_SQL = "packet_index % 16 IN (2, 3, 5, 6)"
EXTRA_SQL = "CASE packet_index % 16 WHEN 3 THEN 24 WHEN 5 THEN 8 WHEN 6 THEN 16 WHEN 15 THEN 4 ELSE 0 END"

SKIPS_SQL = "CASE WHEN packet_index % 53 = 0 THEN 'non_ip' WHEN packet_index % 51 = 0 THEN 'ip_fragment' WHEN packet_index % 50 = 0 THEN 'non_tcp_udp' END"
PACKETS_SQL = f"""
e0 AS (
  SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         {BASE_US} + (epoch_us(ts) - {BASE_US}) // {SQUEEZE} AS u
  FROM events
),
e1 AS (
  SELECT *, 1000 + CASE WHEN user_id % 3 = 0 THEN user_id % 4 ELSE 10 + user_id % 50 END AS cl, 2000 + k % 3 AS sv, 80 + (k // 3) % 2 AS pt
  FROM e0
),
e2 AS (
  SELECT *, CASE WHEN event_id % 97 = 0 OR event_id % 2 = 0 THEN cl ELSE sv END AS src_addr, CASE WHEN event_id % 2 = 0 THEN sv ELSE cl END AS dst_addr
  FROM e1
),
packets AS (
  SELECT CAST((u - {BASE_US}) // {CHUNK_US} AS INT) AS chunk, event_id + 1 AS packet_index, u / 1e6 AS timestamp, 4 AS ip_version,
         CASE WHEN event_id % 3 = 0 THEN 17 ELSE 6 END AS protocol,
         src_addr, '10.0.' || (src_addr // 256) || '.' || (src_addr % 256) AS src_ip, CASE WHEN event_id % 2 = 0 THEN 40000 ELSE pt END AS src_port,
         dst_addr, '10.0.' || (dst_addr // 256) || '.' || (dst_addr % 256) AS dst_ip, CASE WHEN event_id % 2 = 0 THEN pt ELSE 40000 END AS dst_port,
         CAST(least(60 + 10 * k, 96) AS BIGINT) AS captured_frame_length, CAST(60 + 10 * k AS BIGINT) AS original_frame_length,
         CAST(46 + 10 * k AS BIGINT) AS ip_total_length, CAST(10 * k AS BIGINT) AS transport_payload_length,
         CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_type = 'signup' THEN 2 WHEN event_type = 'click' THEN 18
              WHEN event_type = 'error' THEN 4 WHEN event_type = 'purchase' THEN 17 ELSE 16 END AS tcp_flags
  FROM e2
)"""

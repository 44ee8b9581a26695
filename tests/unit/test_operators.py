"""Semantics of flows, cohort, routing and context on small tables with known values."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions.keys import gapless_ids, with_key
from packetloom.operators import cohort as co
from packetloom.operators import context as cx
from packetloom.operators import flows as fl
from packetloom.operators import routing as ro

PACKET = (
    "packet_index long, timestamp double, ip_version int, protocol int, src_addr long, src_ip string, src_port int, dst_addr long, dst_ip string, dst_port int, "
    "captured_frame_length long, original_frame_length long, ip_total_length long, transport_payload_length long, tcp_flags int"
)


def packet(index, time, src, sport, dst, dport, flags=16, protocol=6, captured=60, original=70, ip=50, payload=10):
    return (index, float(time), 4, protocol, src, f"h{src}", sport, dst, f"h{dst}", dport, captured, original, ip, payload, flags if protocol == 6 else 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKET).repartition(3)


def test_flows_follow_capture_order(spark):
    rows = [
        packet(1, 10, 2, 80, 1, 1000, flags=16),  # the larger endpoint is first
        packet(2, 50, 3, 53, 1, 53, protocol=17),
        packet(3, 12, 1, 1000, 2, 80, flags=2, captured=61, original=99, ip=40, payload=0),
        packet(4, 9, 2, 80, 1, 1000, flags=18),  # earlier in time, last in capture
        packet(5, 9, 1, 1000, 2, 80, flags=2 | 4 | 1),
        packet(6, 1000, 2, 80, 1, 1000, protocol=17),
        packet(7, 5, 4, 7, 4, 7, flags=2),  # to itself
    ]
    got = [r.asDict() for r in fl.flow_table(frame(spark, rows)).orderBy("flow_id").collect()]
    assert [r["flow_id"] for r in got] == [1, 2, 3, 4]
    one = got[0]
    assert (one["src_ip"], one["src_port"], one["dst_ip"], one["packet_count"]) == ("h2", 80, "h1", 4)
    assert (one["start_time"], one["end_time"], one["duration"]) == (10.0, 9.0, -1.0)
    assert (one["captured_frame_bytes"], one["original_frame_bytes"], one["ip_bytes"], one["transport_payload_bytes"]) == (241, 309, 190, 30)
    assert (one["initial_syn_sender_ip"], one["initial_syn_sender_port"], one["initial_syn_receiver_ip"], one["initial_syn_receiver_port"]) == ("h1", 1000, "h2", 80)
    assert got[1]["initial_syn_sender_ip"] is None and got[2]["protocol"] == 17 and got[3]["initial_syn_sender_ip"] == "h4"
    assert set(fl.flow_violations(fl.flow_table(frame(spark, rows))).first()) == {0}


def test_gapless_ids_over_ranges(spark):
    df = spark.createDataFrame([(k * k,) for k in range(200)], "x long").repartition(5)
    got = gapless_ids(df, "x", "id", span=100).orderBy("x").collect()
    assert [r.id for r in got] == list(range(1, 201))


def test_violations_are_counted(spark):
    flows = fl.flow_table(frame(spark, [packet(1, 1, 1, 1, 2, 2), packet(2, 1, 3, 1, 2, 2)]))
    broken = flows.withColumns({"flow_id": F.lit(1).cast("long"), "duration": F.lit(5.0), "initial_syn_sender_ip": F.lit("h"), "dst_port": F.lit(70000)})
    assert fl.flow_violations(broken).first().asDict() == {"bad_ids_or_counts": 0, "bad_protocols": 0, "bad_intervals": 2, "partial_syn": 2, "bad_ports": 2, "duplicate_ids": 1}


@pytest.mark.parametrize("bad", [(), (1, 1), (0,), (-1,), (True,), (1.0,), ("1",)])
def test_packet_counts(bad):
    with pytest.raises(ValueError):
        co.checked_counts(bad)


def test_context_source(spark):
    rows = [
        packet(1, 1, 1, 1, 2, 2, flags=16), packet(2, 2, 2, 2, 1, 1, flags=2),  # a late SYN from the other side
        packet(3, 3, 3, 1, 2, 2, flags=18), packet(4, 4, 4, 1, 2, 2, protocol=17),
    ]
    got = co.select_cohort(fl.flow_table(frame(spark, rows)), (2, 1)).orderBy("target_flow_id").collect()
    assert [(r.context_source_ip, r.context_source_basis) for r in got] == [("h2", "initial_syn_sender"), ("h3", "first_observed_src"), ("h4", "first_observed_src")]
    assert tuple(got[0].asDict()) == co.COHORT_COLUMNS


def cohort_of(spark, rows):
    """Rows: id, protocol, src, sport, dst, dport, start, end, source."""
    made = [
        (i, 1, 4, p, f"h{s}", sp, f"h{d}", dp, float(a), float(b), float(b - a), None, None, None, None, source, "first_observed_src", s, d) for i, p, s, sp, d, dp, a, b, source in rows
    ]
    kinds = "target_flow_id long, observed_packet_count long, ip_version int, protocol int, src_ip string, src_port int, dst_ip string, dst_port int, target_start_time double, target_end_time double, target_duration double, "
    kinds += "initial_syn_sender_ip string, initial_syn_sender_port int, initial_syn_receiver_ip string, initial_syn_receiver_port int, context_source_ip string, context_source_basis string, src_addr long, dst_addr long"
    return with_key(spark.createDataFrame(made, kinds)).drop("src_addr", "dst_addr")


def test_index_conflicts(spark):
    base = [1, 6, 1, 1, 2, 2, 0, 0, "h1"]
    fine = cohort_of(spark, [base, [2, 17, *base[2:]]])
    assert {r.conflict: r.n for r in co.index_conflicts(fine).collect()} == {"key_with_ids": 0, "id_with_keys": 0}
    twice = cohort_of(spark, [base, [2, 6, 2, 2, 1, 1, 0, 0, "h1"], [3, 6, 5, 5, 6, 6, 0, 0, "h5"], [3, 6, 7, 5, 6, 6, 0, 0, "h5"]])
    assert {r.conflict: r.n for r in co.index_conflicts(twice).collect()} == {"key_with_ids": 1, "id_with_keys": 1}


@pytest.mark.parametrize("rows", [None, 10, 10**9])
def test_routing_and_retention(spark, rows):
    cohort = cohort_of(spark, [[1, 6, 1, 1000, 2, 80, 0, 0, "h1"], [2, 17, 3, 53, 2, 53, 0, 0, "h3"]])
    packets = frame(
        spark,
        [
            packet(1, 1, 2, 80, 1, 1000, flags=16),  # of flow 1, no control flag
            packet(2, 1, 1, 1000, 2, 80, flags=2),  # both
            packet(3, 1, 9, 1, 1, 2, flags=4), packet(4, 1, 9, 1, 8, 2, flags=4),  # to a candidate; not
            packet(5, 1, 1, 1, 9, 9, protocol=17),  # UDP of a candidate that is one through TCP
            packet(6, 1, 9, 9, 3, 53, protocol=17),  # UDP to a candidate
            packet(7, 1, 3, 9, 1, 9, flags=1), packet(8, 1, 1, 5, 1, 5, flags=2),
        ],
    )
    targets = ro.route_to_targets(packets, cohort, rows)
    assert sorted((r.target_flow_id, r.packet_index) for r in targets.collect()) == [(1, 1), (1, 2)]
    kept = ro.retain_source_context(packets, cohort, rows)
    assert sorted(r.packet_index for r in kept.collect()) == [2, 3, 5, 7, 8]
    ends = sorted((r.packet_index, r.context_source_ip, r.outbound, r.inbound) for r in ro.expand_endpoints(kept).collect())
    assert ends == [
        (2, "h1", True, False), (2, "h2", False, True), (3, "h1", False, True), (3, "h9", True, False), (5, "h1", True, False), (7, "h1", False, True), (7, "h3", True, False), (8, "h1", True, True),
    ]


START, END = 1000.125, 1010.125


def test_tuple_boundaries(spark):
    """A packet at each edge of every neighbourhood, and one just outside the widest."""
    cohort = cohort_of(spark, [[1, 6, 1, 1, 2, 2, START, END, "h1"], [2, 6, 3, 1, 2, 2, START, END, "h3"]])
    times = [START - n for n in (0.125, 1, 10, 60, 300, 301)] + [START, START + 1, END] + [END + n for n in (0.125, 1, 10, 60, 300, 301)]
    targets = spark.createDataFrame([(1, t) for t in times], "target_flow_id long, timestamp double")
    one, two = (r.asDict() for r in cx.tuple_metrics(cohort, targets).orderBy("target_flow_id").collect())
    assert (one["same_tuple_packet_count_24h"], one["same_tuple_before_count"], one["same_tuple_target_interval_count"], one["same_tuple_after_count"]) == (15, 6, 3, 6)
    assert [one[f"same_tuple_{s}_{n}s_count"] for n in (1, 10, 60, 300) for s in ("before", "after")] == [2, 2, 3, 3, 4, 4, 5, 5]
    assert (one["previous_same_tuple_gap_seconds"], one["next_same_tuple_gap_seconds"]) == (0.125, 0.125)
    assert two["same_tuple_packet_count_24h"] == 0 and two["previous_same_tuple_timestamp"] is None and two["next_same_tuple_gap_seconds"] is None


def endpoints(spark, rows):
    return ro.expand_endpoints(frame(spark, rows))


def test_source_windows_and_flags(spark):
    cohort = cohort_of(spark, [[1, 6, 1, 1, 2, 2, START, END, "h1"], [2, 17, 1, 1, 2, 2, START, END, "h1"], [3, 6, 9, 1, 2, 2, START, END, "h9"]])
    rows = [
        packet(1, START - 60, 1, 1, 2, 80, flags=2), packet(2, START - 60.5, 1, 1, 3, 80, flags=2), packet(3, END + 60, 2, 80, 1, 1, flags=18),
        packet(4, END + 300, 1, 1, 2, 81, flags=7), packet(5, START - 301, 1, 1, 4, 82, flags=4), packet(6, START + 1, 1, 5, 1, 5, flags=1),
        packet(7, START, 1, 1, 2, 53, protocol=17), packet(8, END + 301, 1, 1, 3, 53, protocol=17), packet(9, START, 2, 1, 1, 53, protocol=17),
    ]
    ends = endpoints(spark, rows)
    day = {r.context_source_ip: tuple(r)[1:] for r in cx.source_day(cohort, ends, 6).collect()}
    assert day == {"h1": (6, 3, 1, 2, 0, 2, 1, 4, 4, 5), "h9": (0,) * 10}
    window = lambda p, n: {r.target_flow_id: tuple(r)[1:] for r in cx.source_window(cohort, ends, p, n).collect()}
    assert window(6, 60) == {1: (3, 1, 1, 0, 0, 1, 1, 2, 2, 2), 3: (0,) * 10}
    assert window(6, 300) == {1: (5, 3, 1, 1, 0, 2, 1, 3, 3, 4), 3: (0,) * 10}
    assert window(17, 300) == {2: (1, 1, 1, 1)}
    assert {r.context_source_ip: tuple(r)[1:] for r in cx.source_day(cohort, ends, 17).collect()} == {"h1": (2, 2, 1, 2)}

    targets = spark.createDataFrame([], "target_flow_id long, timestamp double")
    result = cx.context_table(cohort, targets, ends)
    assert tuple(result.columns) == cx.RESULT_COLUMNS and len(result.columns) == 71
    rows = {r.target_flow_id: r.asDict() for r in result.collect()}
    assert rows[1]["tcp_control_packet_count_24h"] == 6 and rows[1]["udp_outbound_packet_count_24h"] == 0
    assert rows[2]["udp_outbound_packet_count_window_60s"] == 1 and rows[2]["tcp_control_packet_count_24h"] == 0
    assert not any(v is None for k, v in rows[3].items() if k.startswith(("tcp", "udp")))


def test_no_interpretive_columns():
    assert not [c for c in cx.RESULT_COLUMNS if any(w in c for w in ("attack", "scan", "benign", "malicious", "label", "class"))]


def test_reversed_intervals(spark):
    cohort = cohort_of(spark, [[1, 6, 1, 1, 2, 2, 5, 4, "h1"], [2, 6, 3, 1, 2, 2, 4, 4, "h3"]])
    assert [r.target_flow_id for r in co.reversed_intervals(cohort).collect()] == [1]


def test_windows_against_brute_force(spark):
    """Random packets with many ties at the edges; some flows end long before they start, within one bucket or not."""
    rng = random.Random(5)
    time = lambda: 1000 + rng.randrange(0, 2400) * 0.5
    rows = [packet(k, time(), rng.choice((1, 1, 1, 3)), 7, rng.choice((2, 3, 4, 5)), rng.choice((80, 81)), flags=rng.choice((1, 2, 4, 18)), protocol=rng.choice((6, 17))) for k in range(400)]
    given = []
    for k in range(60):
        start = time()
        given.append([k, rng.choice((6, 17)), 1, 1, 2, 2, start, start + rng.choice((0, 0.5, 20, 400, -30, -90, -119.5, -121, -500, -700)), rng.choice(("h1", "h1", "h3", "h8"))])
    cohort, ends = cohort_of(spark, given), endpoints(spark, rows)
    seen = [r.asDict() for r in ends.collect()]
    for protocol, n in ((6, 60), (6, 300), (17, 60), (17, 300)):
        got = {r.target_flow_id: tuple(r)[1:] for r in cx.source_window(cohort, ends, protocol, n).collect()}
        assert got.keys() == {g[0] for g in given if g[1] == protocol}
        for k, p, *_, start, end, source in given:
            if p != protocol:
                continue
            near = [r for r in seen if r["protocol"] == p and r["context_source_ip"] == source and start - n <= r["timestamp"] <= end + n]
            out = [r for r in near if r["outbound"]]
            flags = []
            if p == 6:
                inn = [r for r in near if r["inbound"]]
                flags = [sum(r["tcp_flags"] & 18 == 2 for r in out), sum(r["tcp_flags"] & 18 == 18 for r in inn)]
                flags += [sum(bool(r["tcp_flags"] & bit) for r in side) for bit in (4, 1) for side in (out, inn)]
            unique = [len({r["dst_ip"] for r in out}), len({r["dst_port"] for r in out}), len({(r["dst_ip"], r["dst_port"]) for r in out})]
            assert got[k] == (len(near), *flags, *unique), (k, n)


def test_windows_of_a_hot_source(spark):
    """A source with many packets to few destinations: flows meet destinations of buckets, not packets."""
    flows, packets = 200, 3000
    cohort = cohort_of(spark, [[k, 6, 1, k, 2, 80, START, END, "h1"] for k in range(flows)])
    ends = endpoints(spark, [packet(k, START + k / packets, 1, 5, 2 + k % 3, 80, flags=2) for k in range(packets)])
    assert {tuple(r)[1:] for r in cx.source_window(cohort, ends, 6, 60).collect()} == {(packets, packets, 0, 0, 0, 0, 0, 3, 1, 3)}
    assert cx.destinations(ends).count() == 3  # in one bucket
    plan = cx.source_window(cohort, ends, 6, 60)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

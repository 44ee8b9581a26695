import gzip
import io
import struct

import pytest

from packetloom.functions.decode import address_text
from packetloom.sources import capture as cap
from packetloom.sources.containers import OVERRUN_LIMIT, CaptureError, records
from tests.helpers import frames as fr

A, B = fr.frame(), fr.frame(protocol=17, payload=b"xyz")


def read(data):
    return list(records(io.BytesIO(data)))


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("nano", [False, True])
@pytest.mark.parametrize("zipped", [False, True])
def test_classic(order, nano, zipped):
    data = fr.classic([(1000.125, A), (999.5, B, 200)], order=order, nano=nano)
    got = read(gzip.compress(data) if zipped else data)
    assert [(r.packet_index, r.timestamp, r.captured_length, r.original_length) for r in got] == [(1, 1000.125, len(A), len(A)), (2, 999.5, len(B), 200)]
    assert [r.frame for r in got] == [A, B]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("resolution, offset", [(6, 0), (9, 100), (6 | 128, -5)])
def test_pcapng(order, resolution, offset):
    data = fr.pcapng([(1000.125, A), (1001.5, B, 300)], order=order, resolution=resolution, offset=offset)
    assert [(r.packet_index, r.timestamp, r.original_length) for r in read(data)] == [(1, 1000.125, len(A)), (2, 1001.5, 300)]


def test_pcapng_indexes_continue_over_sections_and_unknown_blocks_are_skipped():
    one = fr.section() + fr.interface() + fr.enhanced(1.0, A) + fr.block(0x99, b"abcd")
    two = fr.section(">") + fr.interface(">") + fr.enhanced(2.0, B, order=">")
    assert [r.packet_index for r in read(one + two)] == [1, 2]


def test_pcapng_declared_section():
    inner = fr.interface() + fr.enhanced(1.0, A)
    assert len(read(fr.section(length=len(inner)) + inner)) == 1
    for length in (len(inner) - 4, len(inner) + 4):
        with pytest.raises(CaptureError):
            read(fr.section(length=length) + inner)


def test_obsolete_packet_block():
    body = struct.pack("<HHIIII", 0, 0, 0, 5_000_000, len(A), len(A)) + A
    (r,) = read(fr.section() + fr.interface() + fr.block(2, body))
    assert (r.timestamp, r.frame) == (5.0, A)


GOOD = fr.pcapng([(1.0, A)])
DAMAGED = {
    "empty": b"",
    "unknown": b"abcdefgh",
    "short header": fr.classic()[:10],
    "short record header": fr.classic([(1.0, A)])[: 24 + 8],
    "short body": fr.classic([(1.0, A)])[:-1],
    "version": fr.classic(version=(2, 3)),
    "snaplen": fr.classic(snaplen=0),
    "link": fr.classic(link=101),
    "caplen": fr.classic([(1.0, A, len(A) - 1)]),
    "fraction": fr.classic() + struct.pack("<IIII", 1, 10**6, 0, 0),
    "gzip": gzip.compress(fr.classic([(1.0, A)]))[:-6],
    "gzip body": gzip.compress(fr.classic([(1.0, A)]))[:20] + b"\xff" * 30,
    "overrun": fr.classic() + struct.pack("<IIII", 1, 0, OVERRUN_LIMIT + 1, OVERRUN_LIMIT + 1),
    "ng version": fr.section(version=(2, 0)),
    "ng link": fr.section() + fr.interface(link=0),
    "ng no interface": fr.section() + fr.enhanced(1.0, A),
    "ng simple": fr.section() + fr.interface() + fr.block(3, bytes(8)),
    "ng snaplen": fr.section() + fr.interface(snaplen=20) + fr.enhanced(1.0, A),
    "ng trailer": GOOD[:-4] + b"\x00\x00\x00\x04",
    "ng cut": GOOD[:-3],
    "ng block length": fr.section() + struct.pack("<II", 1, 6),
    "ng option": fr.section() + fr.block(1, struct.pack("<HHIHH", 1, 0, 0, 9, 100)),
}


@pytest.mark.parametrize("name", DAMAGED)
def test_damage_is_fatal(name):
    with pytest.raises(CaptureError):
        read(DAMAGED[name])


def test_classic_overrun_within_the_limit():
    long = A + bytes(128)
    assert read(fr.classic([(1.0, long, 1208)], snaplen=96))[0].frame == long


def facts(*given):
    data = [(x, len(x)) if isinstance(x, bytes) else x for x in given]
    from packetloom.sources.containers import Record

    return cap.batch_of("c", [Record(i, float(i), f, len(f), n) for i, (f, n) in enumerate(data, 1)]).to_pylist()


def test_decode():
    v6 = dict(src="2001:db8::1", dst="2001:db8::2")
    got = facts(A, B, fr.frame(**v6, payload=b"ab"), fr.frame(vlans=(0x8100, 0x88A8, 0x9100), flags=0x12), (fr.frame(payload=b"x" * 100)[:60], 154))
    assert [(r["skip_reason"], r["ip_version"], r["protocol"], r["tcp_flags"], r["ip_total_length"], r["transport_payload_length"]) for r in got] == [
        (None, 4, 6, 2, 40, 0), (None, 4, 17, 0, 31, 3), (None, 6, 6, 2, 62, 2), (None, 4, 6, 18, 40, 0), (None, 4, 6, 2, 140, 100),
    ]
    assert [(got[2][k]) for k in ("src_ip", "src_port", "dst_ip", "dst_port")] == ["2001:db8::1", 1234, "2001:db8::2", 80]
    assert got[0]["src_addr"] == bytes([192, 0, 2, 10])


def changed(data, at, value):
    return data[:at] + value + data[at + len(value) :]


REASONS = [
    (A[:10], "packet_header_exceeds_declared_length"),
    ((A[:10], 60), "capture_truncated_undecodable"),
    ((A[:40], 60), "capture_truncated_undecodable"),
    ((A, 20), "packet_header_exceeds_declared_length"),
    (changed(A, 12, b"\x08\x06"), "non_ip"),
    (changed(A, 14, b"\x65"), "ethernet_ip_version_mismatch"),
    (changed(A, 14, b"\x44"), "malformed_ipv4_length"),
    (changed(A, 16, b"\x00\x10"), "malformed_ipv4_length"),
    (changed(A, 16, b"\x01\x00"), "ipv4_length_exceeds_original_frame_length"),
    (changed(A, 16, b"\x00\x20"), "packet_header_exceeds_declared_length"),
    (fr.frame(fragment=0x2000), "ip_fragment"),
    (fr.frame(protocol=1, fragment=1), "ip_fragment"),
    (fr.frame(fragment=0x4000), None),
    (fr.frame(protocol=1), "non_tcp_udp"),
    (changed(A, 46, b"\x40"), "malformed_tcp_header_length"),
    (changed(A, 46, b"\x60"), "packet_header_exceeds_declared_length"),
    ((changed(fr.frame(sport=0, dport=0, flags=0, fragment=0x4000, payload=b"x" * 32), 46, b"\x00")[:54], 86), "malformed_tcp_header_length"),
    (changed(B, 38, b"\x00\x07"), "malformed_udp_length"),
    (changed(B, 38, b"\x00\x40"), "malformed_udp_length"),
    (fr.frame(payload=b"abc")[:-1], "ipv4_length_exceeds_original_frame_length"),
]
V6 = dict(src="2001:db8::1", dst="2001:db8::2")
REASONS += [
    (changed(fr.frame(**V6), 18, b"\x01\x00"), "ipv6_length_exceeds_original_frame_length"),
    (fr.frame(**V6, protocol=17, next_header=0, extensions=bytes([17, 0]) + bytes(6)), None),
    (fr.frame(**V6, next_header=60, extensions=bytes([43, 0]) + bytes(6) + bytes([6, 0]) + bytes(6)), None),
    (fr.frame(**V6, next_header=44, extensions=bytes([6, 0, 0, 0]) + bytes(4)), None),
    (fr.frame(**V6, next_header=44, extensions=bytes([6, 0, 0, 1]) + bytes(4)), "ip_fragment"),
    (fr.frame(**V6, next_header=51, extensions=bytes([6, 0]) + bytes(6)), "malformed_ipv6_authentication_header_length"),
    (fr.frame(**V6, next_header=51, extensions=bytes([6, 1]) + bytes(10)), "malformed_ipv6_authentication_header_length"),
    (fr.frame(**V6, next_header=51, extensions=bytes([6, 2]) + bytes(14)), None),
    (fr.frame(**V6, next_header=50, extensions=bytes(8)), "non_tcp_udp"),
    (fr.frame(**V6, next_header=0, extensions=bytes([6, 200]) + bytes(6)), "packet_header_exceeds_declared_length"),
]


def test_reasons():
    got = facts(*[f for f, _ in REASONS])
    assert [r["skip_reason"] for r in got] == [r for _, r in REASONS]
    assert all(r["src_ip"] is None and r["protocol"] is None for r in got if r["skip_reason"])


def test_address_text():
    import ipaddress

    for x in ("1.2.3.4", "::", "::1", "2001:db8::ff00:42:8329", "fe80::1"):
        assert address_text(ipaddress.ip_address(x).packed) == x
    assert address_text(ipaddress.ip_address("::ffff:1.2.3.4").packed) == "::ffff:102:304"


def test_source(spark, tmp_path):
    fr.write(tmp_path / "202401010000.pcap.gz", fr.classic([(1.0, A), (2.0, fr.frame(protocol=1))]), compressed=True)
    fr.write(tmp_path / "202401010015.pcapng", fr.pcapng([(3.0, B)]))
    packets = cap.read(spark, str(tmp_path))
    assert [(r.chunk_id, r.packet_index, r.protocol) for r in cap.decoded(packets).orderBy("timestamp").collect()] == [("202401010000", 1, 6), ("202401010015", 1, 17)]
    assert [tuple(r) for r in cap.skip_counts(packets).collect()] == [("202401010000", "non_tcp_udp", 1)]


def test_source_errors(spark, tmp_path):
    fr.write(tmp_path / "a.pcap", fr.classic([(1.0, A)])[:-1])
    fr.write(tmp_path / "b.pcap", fr.classic([(1.0, A)]))
    with pytest.raises(Exception, match="CaptureError"):
        cap.read(spark, str(tmp_path)).collect()
    rows = cap.read(spark, str(tmp_path), on_error="row").collect()
    assert {(r.chunk_id, r.error is None) for r in rows} == {("a", False), ("b", True)}

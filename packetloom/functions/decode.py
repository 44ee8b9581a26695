"""Packet facts from Ethernet frames, many at once.

A batch of frames is one byte array with a place for each frame. Every rule is a mask over the frames that are still
undecided; a frame that breaks a rule leaves with that rule's reason, so the first broken rule decides.
"""

from __future__ import annotations

import socket

import numpy as np
import pyarrow as pa

#: Reasons, in a fixed order; a packet without one is decoded.
MALFORMED = (
    "packet_header_exceeds_declared_length", "incomplete_packet_header", "ethernet_ip_version_mismatch", "malformed_ipv4_length",
    "ipv4_length_exceeds_original_frame_length", "ipv6_length_exceeds_original_frame_length",
    "malformed_ipv6_authentication_header_length", "malformed_tcp_header_length", "malformed_udp_length",
)
UNSUPPORTED = ("non_ip", "non_tcp_udp", "capture_truncated_undecodable", "ip_fragment")
REASONS = MALFORMED + UNSUPPORTED
_CODE = {r: i for i, r in enumerate(REASONS)}

VLAN_TYPES, IPV4, IPV6 = (0x8100, 0x88A8, 0x9100), 0x0800, 0x86DD
EXTENSIONS, FRAGMENT, AUTHENTICATION = (0, 43, 44, 51, 60), 44, 51
TCP, UDP = 6, 17

FACTS = {
    "ip_version": pa.int32(), "protocol": pa.int32(), "src_addr": pa.binary(), "src_ip": pa.string(), "src_port": pa.int32(),
    "dst_addr": pa.binary(), "dst_ip": pa.string(), "dst_port": pa.int32(), "ip_total_length": pa.int64(), "transport_payload_length": pa.int64(),
    "tcp_flags": pa.int32(), "skip_reason": pa.string(),
}


class _Frames:
    """Frames under decoding: what is known of each, and which are undecided."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, captured: np.ndarray, original: np.ndarray):
        self.data = np.append(data, np.zeros(64, np.uint8))
        self.starts, self.captured, self.original = starts, captured, original
        self.n = len(starts)
        self.open = np.ones(self.n, bool)
        self.reason = np.full(self.n, -1)
        self.pos = np.zeros(self.n, np.int64)
        self.end = np.full(self.n, np.iinfo(np.int64).max)

    def byte(self, at: np.ndarray | int, where: np.ndarray | None = None) -> np.ndarray:
        place = np.minimum(self.starts + at, len(self.data) - 1)
        return self.data[place].astype(np.int64)

    def word(self, at: np.ndarray | int) -> np.ndarray:
        return self.byte(at) << 8 | self.byte(np.asarray(at) + 1)

    def drop(self, mask: np.ndarray, reason: str) -> None:
        mask = mask & self.open
        self.reason[mask] = _CODE[reason]
        self.open &= ~mask

    def need(self, among: np.ndarray, end: np.ndarray | int) -> None:
        """Bytes up to `end` must be declared, and captured."""
        end = np.broadcast_to(end, self.n)
        self.drop(among & ((end > self.original) | (end > self.end)), "packet_header_exceeds_declared_length")
        absent = among & (end > self.captured)
        self.drop(absent & (self.captured < self.original), "capture_truncated_undecodable")
        self.drop(absent, "incomplete_packet_header")


def _network(f: _Frames) -> tuple[np.ndarray, np.ndarray]:
    """Down to the IP header: version of each frame, and the start of its IP header."""
    f.need(f.open, 14)
    kind = f.word(12)
    f.pos[:] = 14
    while (tagged := f.open & np.isin(kind, VLAN_TYPES)).any():
        f.need(tagged, f.pos + 4)
        tagged &= f.open
        kind = np.where(tagged, f.word(f.pos + 2), kind)
        f.pos[tagged] += 4
    f.drop(~np.isin(kind, (IPV4, IPV6)), "non_ip")
    version = np.where(kind == IPV4, 4, 6)
    f.need(f.open, f.pos + 1)
    f.drop(f.byte(f.pos) >> 4 != version, "ethernet_ip_version_mismatch")
    return version, f.pos.copy()


def _ipv4(f: _Frames, v4: np.ndarray, ip: np.ndarray, total: np.ndarray, protocol: np.ndarray) -> None:
    f.need(f.open & v4, ip + 20)
    header, length = (f.byte(ip) & 15) * 4, f.word(ip + 2)
    f.drop(v4 & ((header < 20) | (length < header)), "malformed_ipv4_length")
    f.drop(v4 & (ip + length > f.original), "ipv4_length_exceeds_original_frame_length")
    f.end = np.where(v4, ip + length, f.end)
    f.need(f.open & v4, ip + header)
    f.drop(v4 & (f.word(ip + 6) & 0x3FFF != 0), "ip_fragment")
    total[v4], protocol[v4] = length[v4], f.byte(ip + 9)[v4]
    f.pos = np.where(v4, ip + header, f.pos)


def _ipv6(f: _Frames, v6: np.ndarray, ip: np.ndarray, total: np.ndarray, protocol: np.ndarray) -> None:
    f.need(f.open & v6, ip + 40)
    length = 40 + f.word(ip + 4)
    f.drop(v6 & (ip + length > f.original), "ipv6_length_exceeds_original_frame_length")
    f.end = np.where(v6, ip + length, f.end)
    total[v6], protocol[v6] = length[v6], f.byte(ip + 6)[v6]
    f.pos = np.where(v6, ip + 40, f.pos)
    while (at := f.open & v6 & np.isin(protocol, EXTENSIONS)).any():
        f.need(at, f.pos + 2)
        following, units = f.byte(f.pos), f.byte(f.pos + 1)
        fragment, signed = at & (protocol == FRAGMENT), at & (protocol == AUTHENTICATION)
        size = np.where(fragment, 8, np.where(signed, (units + 2) * 4, (units + 1) * 8))
        f.need(fragment & f.open, f.pos + 8)
        f.drop(fragment & (f.word(f.pos + 2) & 0xFFF9 != 0), "ip_fragment")
        f.drop(signed & ((size < 12) | (size % 8 != 0)), "malformed_ipv6_authentication_header_length")
        f.need(at & f.open, f.pos + size)
        at &= f.open
        f.pos[at] += size[at]
        protocol[at] = following[at]


def _addresses(f: _Frames, at: np.ndarray, v4: np.ndarray, ok: np.ndarray) -> tuple[list, list]:
    """Packed addresses and their text; each distinct address is printed once."""
    wide = f.data[np.minimum(f.starts + at, len(f.data) - 17)[:, None] + np.arange(16)]
    packed: list = [None] * f.n
    text: list = [None] * f.n
    names: dict[bytes, str] = {}
    for i in np.flatnonzero(ok).tolist():
        raw = wide[i, : 4 if v4[i] else 16].tobytes()
        if raw not in names:
            names[raw] = address_text(raw)
        packed[i], text[i] = raw, names[raw]
    return packed, text


def address_text(packed: bytes) -> str:
    """Canonical text of an address; IPv4-mapped IPv6 addresses end in two groups of hexadecimal digits."""
    text = socket.inet_ntop(socket.AF_INET if len(packed) == 4 else socket.AF_INET6, packed)
    if len(packed) == 16 and "." in text:
        head = text[: text.rindex(":") + 1]
        return f"{head}{int.from_bytes(packed[12:14]):x}:{int.from_bytes(packed[14:]):x}"
    return text


def decode(frames: pa.Array, captured: np.ndarray, original: np.ndarray) -> dict[str, pa.Array]:
    """Facts of each frame, or its skip reason (then all facts are null). Flags are 0 for UDP."""
    _, offsets, data = frames.buffers()
    n = len(frames)
    starts = np.frombuffer(offsets, np.int32)[frames.offset : frames.offset + n].astype(np.int64) if n else np.zeros(0, np.int64)
    f = _Frames(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), starts, captured.astype(np.int64), original.astype(np.int64))
    version, ip = _network(f)
    total, protocol = np.zeros(n, np.int64), np.full(n, -1)
    v4 = version == 4
    _ipv4(f, v4, ip, total, protocol)
    _ipv6(f, ~v4, ip, total, protocol)

    f.drop(~np.isin(protocol, (TCP, UDP)), "non_tcp_udp")
    tcp, udp = protocol == TCP, protocol == UDP
    f.need(f.open, f.pos + np.where(tcp, 20, 8))
    src_port, dst_port = f.word(f.pos), f.word(f.pos + 2)
    header = (f.byte(f.pos + 12) >> 4) * 4
    f.drop(tcp & (header < 20), "malformed_tcp_header_length")
    f.need(f.open & tcp, f.pos + header)
    length = f.word(f.pos + 4)
    f.drop(udp & ((length < 8) | (f.pos + length > f.end)), "malformed_udp_length")
    f.need(f.open & (f.captured == f.original), f.end)
    payload = np.where(tcp, f.end - f.pos - header, length - 8)
    flags = np.where(tcp, f.byte(f.pos + 13), 0)

    ok, gone = f.open, ~f.open
    src_addr, src_ip = _addresses(f, np.where(v4, ip + 12, ip + 8), v4, ok)
    dst_addr, dst_ip = _addresses(f, np.where(v4, ip + 16, ip + 24), v4, ok)
    values = {
        "ip_version": version, "protocol": protocol, "src_addr": src_addr, "src_ip": src_ip, "src_port": src_port, "dst_addr": dst_addr, "dst_ip": dst_ip,
        "dst_port": dst_port, "ip_total_length": total, "transport_payload_length": payload, "tcp_flags": flags,
    }
    out = {k: pa.array(v, FACTS[k]) if isinstance(v, list) else pa.array(v, FACTS[k], mask=gone) for k, v in values.items()}
    names = np.array([*REASONS, ""], object)
    out["skip_reason"] = pa.array(names[f.reason].tolist(), pa.string(), mask=ok)
    return out


def decode_table(frames):
    """Facts of a table of (packet_index, frame, captured_frame_length, original_frame_length), in Arrow batches."""
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(["packet_index long", *(f"{name} {kinds[kind]}" for name, kind in FACTS.items())])

    def run(batches):
        for batch in batches:
            lengths = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("captured_frame_length", "original_frame_length")]
            yield pa.RecordBatch.from_pydict({"packet_index": batch.column("packet_index"), **decode(batch.column("frame"), *lengths)})

    return frames.select("packet_index", "frame", "captured_frame_length", "original_frame_length").mapInArrow(run, schema)

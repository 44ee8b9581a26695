"""Synthetic frames and captures, made without the library."""

import gzip
import ipaddress
import struct


def frame(src="192.0.2.10", dst="192.0.2.2", sport=1234, dport=80, protocol=6, flags=2, payload=b"", fragment=0, vlans=(), extensions=b"", next_header=None):
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    match protocol:
        case 6:
            body = struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0)
        case 17:
            body = struct.pack("!HHHH", sport, dport, 8 + len(payload), 0)
        case _:
            body = bytes(8)
    body += payload
    if a.version == 4:
        ip = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 0, fragment, 64, protocol, 0)
    else:
        ip = struct.pack("!IHBB", 6 << 28, len(extensions) + len(body), protocol if next_header is None else next_header, 64)
    kind = 0x0800 if a.version == 4 else 0x86DD
    # A tag's type comes before it; the last type is that of the network layer.
    types = b"".join(struct.pack("!HH", k, 1) for k in vlans) + struct.pack("!H", kind)
    return bytes(12) + types + ip + a.packed + b.packed + extensions + body


def classic(records=(), order="<", nano=False, snaplen=65535, link=1, version=(2, 4)):
    ticks = 10**9 if nano else 10**6
    out = struct.pack(f"{order}IHHIIII", 0xA1B23C4D if nano else 0xA1B2C3D4, *version, 0, 0, snaplen, link)
    for time, data, *rest in records:
        original = rest[0] if rest else len(data)
        whole = int(time)
        out += struct.pack(f"{order}IIII", whole, round((time - whole) * ticks), len(data), original) + data
    return out


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    size = struct.pack(f"{order}I", len(body) + 12)
    return struct.pack(f"{order}I", kind) + size + body + size


def section(order="<", length=-1, version=(1, 0)):
    return block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, *version, length), order)


def interface(order="<", snaplen=65535, resolution=6, offset=0, link=1):
    given = struct.pack(f"{order}HHB3x", 9, 1, resolution) + struct.pack(f"{order}HHq", 14, 8, offset) + bytes(4)
    return block(1, struct.pack(f"{order}HHI", link, 0, snaplen) + given, order)


def enhanced(time, data, original=None, order="<", resolution=6, offset=0, number=0):
    ticks = round((time - offset) * (2 ** (resolution & 127) if resolution & 128 else 10**resolution))
    head = struct.pack(f"{order}IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data) if original is None else original)
    return block(6, head + data, order)


def pcapng(records=(), **kw):
    order = kw.get("order", "<")
    inner = {k: v for k, v in kw.items() if k in ("resolution", "offset")}
    out = section(order) + interface(order, **inner)
    return out + b"".join(enhanced(t, d, *rest, order=order, **inner) for t, d, *rest in records)


def write(path, data, compressed=False):
    path.write_bytes(gzip.compress(data, mtime=0) if compressed else data)
    return str(path)

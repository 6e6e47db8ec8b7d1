"""Packet captures: ``binaryFile`` rows decoded in Arrow batches.

The container format has no Spark reader and its records have no fixed width,
so a file is walked in a ``mapInPandas`` task; captures are split over tasks by
file.  Both byte orders, Ethernet with VLAN tags, IPv4, IPv6, TCP, UDP, ICMP.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PACKET = "file string, frame_no long, us long, src_ip string, dst_ip string, transport string, src_port int, dst_port int, tcp_flags int, length int, payload binary"
_COLUMNS = [f.split()[0] for f in PACKET.split(", ")]
_TRANSPORT = {1: "icmp", 6: "tcp", 17: "udp", 58: "icmp"}


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(microseconds, frame) of each record of a capture; a cut record ends it."""
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">"}.get(data[:4])
    if order is None:
        return
    nanos = data[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
    at = 24
    while at + 16 <= len(data):
        seconds, part, size, _ = struct.unpack_from(order + "IIII", data, at)
        at += 16
        if at + size > len(data):
            return
        yield seconds * 1_000_000 + (part // 1000 if nanos else part), data[at : at + size]
        at += size


def decode(frame: bytes) -> dict | None:
    """Addresses, ports and payload of a frame; None if it is not IP."""
    if len(frame) < 14:
        return None
    kind, at = struct.unpack_from(">H", frame, 12)[0], 14
    while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
        kind, at = struct.unpack_from(">H", frame, at + 2)[0], at + 4
    if kind == 0x0800 and len(frame) >= at + 20:
        head = (frame[at] & 15) * 4
        proto, src, dst = frame[at + 9], socket.inet_ntoa(frame[at + 12 : at + 16]), socket.inet_ntoa(frame[at + 16 : at + 20])
        body = frame[at + head : at + max(head, struct.unpack_from(">H", frame, at + 2)[0])]
    elif kind == 0x86DD and len(frame) >= at + 40:
        proto, src, dst = frame[at + 6], socket.inet_ntop(socket.AF_INET6, frame[at + 8 : at + 24]), socket.inet_ntop(socket.AF_INET6, frame[at + 24 : at + 40])
        body = frame[at + 40 :]
    else:
        return None
    out = {"src_ip": src, "dst_ip": dst, "transport": _TRANSPORT.get(proto, str(proto)), "src_port": None, "dst_port": None, "tcp_flags": None, "length": len(frame), "payload": body}
    if proto == 6 and len(body) >= 20:
        out |= {"src_port": int.from_bytes(body[:2], "big"), "dst_port": int.from_bytes(body[2:4], "big"), "tcp_flags": body[13], "payload": body[(body[12] >> 4) * 4 :]}
    elif proto == 17 and len(body) >= 8:
        out |= {"src_port": int.from_bytes(body[:2], "big"), "dst_port": int.from_bytes(body[2:4], "big"), "payload": body[8:]}
    elif proto in (1, 58):
        out["payload"] = body[4:]  # behind type, code and checksum
    return out


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = []
            for number, (us, frame) in enumerate(frames(bytes(content)), 1):
                if (found := decode(frame)) is not None:
                    rows.append({"file": path, "frame_no": number, "us": us} | found)
                if len(rows) == 8192:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=_COLUMNS)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_walk, PACKET)

"""Files by byte ranges against whole walks; numbered lines against a count."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from arcwatch.operators import hosts
from arcwatch.sources import logs, packets, ranges, snapshots

from .test_security import packet


def capture(order: str, n: int, seed: int, end: bytes = b"") -> bytes:
    rng = random.Random(seed)
    out = {"<": b"\xd4\xc3\xb2\xa1", ">": b"\xa1\xb2\xc3\xd4"}[order] + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
    for i in range(n):
        # some payloads hold whole records themselves
        body = rng.randbytes(rng.randrange(0, 400)) if i % 5 else b"".join(struct.pack(order + "IIII", 5, 5, 40, 40) + b"x" * 40 for _ in range(20))
        frame = packet(f"1.1.1.{i % 200}", "2.2.2.2", 1000 + i % 50, 80, 2, body) if i % 11 else b"junk"
        out += struct.pack(order + "IIII", 1000 + i, i, len(frame), len(frame)) + frame
    return out + end


@pytest.mark.parametrize("size", [700, 5000, 1 << 26])
def test_captures_by_ranges_are_those_of_whole_walks(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ranges, "LONGEST", 2000)
    (tmp_path / "a.pcap").write_bytes(capture("<", 300, 1))
    (tmp_path / "b.pcap").write_bytes(capture(">", 120, 2, b"\1\2"))
    # a record whose size is wrong ends the capture
    (tmp_path / "c.pcap").write_bytes(capture("<", 40, 3) + struct.pack("<IIII", 1, 1, 1 << 30, 1 << 30) + capture("<", 40, 4)[24:])
    (tmp_path / "d.txt").write_bytes(b"no capture at all" * 100)
    (tmp_path / "e.pcap").write_bytes(b"")
    order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[:2])
    got = ranges.read_captures(spark, str(tmp_path), size)
    want = order(packets.read_captures(spark, str(tmp_path)))
    assert order(got) == want and len(want) > 350
    if size == 700:
        assert ranges.capture_ranges(spark, str(tmp_path), size).filter("file like '%a.pcap'").count() > 50


def test_a_wrong_start_is_walked_again(spark, tmp_path, monkeypatch):
    """Ranges that look for their start in vain are mended by the ones before."""
    (tmp_path / "a.pcap").write_bytes(capture("<", 60, 7))
    monkeypatch.setattr(ranges.Records, "first", lambda self, start: 24 if start <= 24 else start + 3)
    got = ranges.capture_ranges(spark, str(tmp_path), 4000)
    starts = {r["start"]: (r["entry"], r["frames"]) for r in got.collect()}
    data, at, n, want = capture("<", 60, 7), 24, 0, {}
    while at < len(data):
        want.setdefault(at // 4000 * 4000, (at, n))
        at, n = at + 16 + struct.unpack_from("<I", data, at + 8)[0], n + 1
    assert starts == want


def core(bits: int, segments: list[tuple[int, int, int, bytes]]) -> bytes:
    """An ELF core of (type, flags, vaddr, content)."""
    head, width = (64, 56) if bits == 64 else (52, 32)
    place = head + width * len(segments)
    table, body = b"", b""
    for kind, flags, vaddr, content in segments:
        at = place + len(body)
        table += struct.pack("<IIQQQQQQ", kind, flags, at, vaddr, 0, len(content), 0, 0) if bits == 64 else struct.pack("<IIIIIIII", kind, at, vaddr, 0, len(content), 0, flags, 0)
        body += content
    ident = b"\x7fELF" + bytes([2 if bits == 64 else 1, 1, 1]) + b"\0" * 9
    if bits == 64:
        start = ident + struct.pack("<HHIQQQIHHHHHH", 4, 62, 1, 0, head, 0, 0, head, width, len(segments), 0, 0, 0)
    else:
        start = ident + struct.pack("<HHIIIIIHHHHHH", 4, 3, 1, 0, head, 0, 0, head, width, len(segments), 0, 0, 0)
    return start + table + body


@pytest.mark.parametrize("bits", [64, 32])
def test_cores_are_cut_in_ranges(spark, tmp_path, bits):
    heap = random.Random(1).randbytes(9000).replace(b"\x90", b"a").replace(b"\xcc", b"a")
    heap = heap[:3995] + b"meterpreter" + heap[4006:]  # across the edge at 4000
    stack = b"\0" * 50 + b"password=topsecret99" + b"\0" * 50
    (tmp_path / "core").write_bytes(core(bits, [(1, 6, 0x1000, heap), (4, 4, 0, b"note"), (1, 7, 0x9000, stack), (2, 4, 0, b"dynamic"), (1, 4, 0x100, b"")]))
    (tmp_path / "cut").write_bytes(core(bits, [(1, 5, 0x7000, b"y" * 500)])[:-200])
    (tmp_path / "other").write_bytes(b"x" * 500)
    rows = {(r["file"].rsplit("/", 1)[1], r["region"]): (r["perms"], bytes(r["data"])) for r in ranges.read_cores(spark, str(tmp_path), 4000, 100).collect()}
    assert rows == {
        ("core", "load:0x1000"): ("rw-", heap[:4100]), ("core", "load:0x1fa0"): ("rw-", heap[4000:8100]), ("core", "load:0x2f40"): ("rw-", heap[8000:]),
        ("core", "note:0x0"): ("r--", b"note"), ("core", "load:0x9000"): ("rwx", stack), ("cut", "load:0x7000"): ("r-x", b"y" * 300),
    }
    found = hosts.memory_findings(ranges.read_cores(spark, str(tmp_path), 4000, 100)).select("region", "kind").distinct()
    assert sorted(map(tuple, found.collect())) == [("load:0x1000", "malware"), ("load:0x9000", "credential")]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    rng = random.Random(2)
    for name, n in (("a.log", 4000), ("b.log", 1), ("c.log", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * rng.randrange(60)}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = logs.numbered_lines(spark, str(tmp_path))
        blocks = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_block_start")).distinct().count()
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert blocks > 5 and len(rows) == 4001
    assert all(int(r["line"].split()[1]) + 1 == r["line_no"] and r["file"].endswith(r["line"].split()[0]) for r in rows)


def test_json_sources_with_their_wrappers_and_clocks(spark, tmp_path):
    import json

    alert = {"ts": "2024-03-05T10:00:00Z", "event_type": "shadow", "severity": "critical", "vm_id": "v1", "score_delta": 40, "details": {"path": "", "exe": "/bin/x"}}
    (tmp_path / "a.json").write_text(json.dumps([alert, {"time": "no time", "@timestamp": "2024-03-05T11:00:00+01:00"}]))
    (tmp_path / "b.json").write_text(json.dumps({"vms": [{"first_seen": "2024-03-05T12:00:00Z", "vm_id": "v2", "details": {"path": "/p"}}], "findings": [alert]}))
    (tmp_path / "c.json").write_text(json.dumps({"findings": [alert | {"timestamp": "2024-03-06T00:00:00Z"}]}))
    (tmp_path / "d.json").write_text(json.dumps(alert | {"vm_id": "alone"}))
    (tmp_path / "e.json").write_text("{ no json")
    got = {(str(r["t"]), r["actor"], r["target"], r["severity"], r["score"], r["tags"][0]) for r in snapshots.json_events(spark, str(tmp_path)).withColumn("t", F.timestamp_micros("us")).collect()}
    assert got == {
        ("2024-03-05 10:00:00", "v1", "/bin/x", "critical", 40, "shadow"), ("2024-03-05 10:00:00", "", "", "medium", 0, "alert"), ("2024-03-05 12:00:00", "v2", "/p", "medium", 0, "alert"),
        ("2024-03-06 00:00:00", "v1", "/bin/x", "critical", 40, "shadow"), ("2024-03-05 10:00:00", "alone", "/bin/x", "critical", 40, "shadow"),
    }
    folder = tmp_path / "more"
    folder.mkdir()
    (folder / "y.json").write_text(json.dumps([{"ts": "2024-03-05T10:00:00Z", "file_path": "/f", "tags": ["t"], "meta": {"severity": "high", "mitre": "T1027"}}]))
    assert [(r["category"], r["target"], r["mitre"], r["tags"]) for r in snapshots.json_events(spark, str(folder), "yara").collect()] == [("defense_evasion", "/f", "T1027", ["t"])]
    (folder / "y.json").write_text(json.dumps({"findings": [{"ts": "2024-03-05T10:00:00Z", "path": "/g", "hunt_type": "persistence", "severity": "low"}]}))
    assert [(r["category"], r["target"], r["severity"], r["tags"]) for r in snapshots.json_events(spark, str(folder), "ioc").collect()] == [("persistence", "/g", "low", ["ioc"])]

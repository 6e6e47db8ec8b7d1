"""Sealed frames against plain Python, a changed bit anywhere, replays."""

from __future__ import annotations

import hashlib
import hmac
import json
import struct
import time

from pyspark.sql import functions as F

from arcwatch.sources import frames

PROTOCOL = frames.Protocol(b"AW01", b"arcwatch|agent|", b"enc", b"mac")
MASTER = b"a secret of the tests"


def plain_key(salt: bytes, agent: str) -> bytes:
    known = hmac.new(salt, MASTER, hashlib.sha256).digest()
    return hmac.new(known, PROTOCOL.info + agent.encode() + b"\x01", hashlib.sha256).digest()


def plain_frame(agent: str, counter: int, clock: float, nonce: bytes, payload: bytes) -> bytes:
    name = agent.encode()
    head = PROTOCOL.magic + bytes([2, 2, len(name)]) + name + struct.pack(">Qd", counter, clock) + nonce
    stream, block = b"", 0
    while len(stream) < len(payload):
        stream += hmac.new(plain_key(b"enc", agent), nonce + struct.pack(">I", block), hashlib.sha256).digest()
        block += 1
    text = bytes(a ^ b for a, b in zip(payload, stream))
    body = text + hmac.new(plain_key(b"mac", agent), head + text, hashlib.sha256).digest()
    return head + struct.pack(">I", len(body)) + body


def read(spark, raw, **more):
    df = spark.createDataFrame([(n, None if r is None else bytearray(r)) for n, r in enumerate(raw)], "n int, frame binary")
    return {r["n"]: r for r in frames.opened(df, PROTOCOL, MASTER, **more).collect()}


def test_frames_of_a_plain_sender_are_opened(spark):
    texts = [json.dumps({"vm_id": "é-1", "x": "y" * n}).encode() for n in (0, 1, 20, 31, 32, 33, 300)]
    raw = [plain_frame("é-1", 5 + n, 1_700_000_000.25 + n, bytes([n] * 12), t) for n, t in enumerate(texts)]
    got = read(spark, raw)
    for n, t in enumerate(texts):
        r = got[n]
        assert (r["error"], r["payload"], r["agent_id"], r["counter"], r["clock"], bytes(r["nonce"])) == (None, t.decode(), "é-1", 5 + n, 1_700_000_000.25 + n, bytes([n] * 12))


def test_a_changed_bit_anywhere_is_refused(spark):
    whole = plain_frame("vm", 7, 1_700_000_000.0, b"n" * 12, b'{"vm_id":"vm","a":1}')
    changed = [whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1 :] for i in range(len(whole))]
    cut = [whole[:i] for i in range(0, len(whole), 5)] + [None, b"AW01"]
    got = read(spark, [whole, *changed, *cut])
    assert got[0]["error"] is None
    assert all(r["error"] is not None and r["payload"] is None for n, r in got.items() if n)


def test_what_is_refused_and_why(spark):
    good = b'{"vm_id":"vm"}'
    raw = [
        plain_frame("vm", 1, 1000.0, b"a" * 12, good), plain_frame("vm", 2, 2000.0, b"b" * 12, good), plain_frame("other", 3, 1000.0, b"c" * 12, b"{}"), plain_frame("vm", 4, 1000.0, b"d" * 12, b"no json"),
        plain_frame("vm", 5, 1000.0, b"e" * 12, b'{"vm_id":"you"}'), b"XX01" + plain_frame("vm", 1, 1000.0, b"a" * 12, good)[4:], plain_frame("vm", 6, 1000.0, b"f" * 12, b"{}"),
    ]
    version = bytearray(raw[0])
    version[4] = 9
    mode = bytearray(raw[0])
    mode[5] = 7
    got = read(spark, [*raw, bytes(version), bytes(mode)], agents=["vm"], now=F.lit(1100.0))
    assert [got[n]["error"] for n in range(9)] == [None, "skew", "agent", "payload", "spoof", "malformed", None, "version", "mode"]


def test_replays_and_old_counters(spark):
    came = [("vm", 5, b"a"), ("vm", 6, b"b"), ("vm", 5, b"a"), ("vm", 4, b"c"), ("vm", 9, b"d"), ("vm", 8, b"e"), ("vm", 10, b"d"), ("vm", 10, b"f"), ("x", 1, b"a")]
    raw = [plain_frame(a, c, 1000.0, n * 12, b"{}") for a, c, n in came]
    df = spark.createDataFrame([(n, bytearray(r)) for n, r in enumerate(raw)], "n int, frame binary")
    got = {r["n"]: r["error"] for r in frames.replays(frames.opened(df, PROTOCOL, MASTER), ["n"]).collect()}
    assert [got[n] for n in range(9)] == [None, None, "replay", "counter", None, "counter", "replay", None, None]


def test_both_modes_round_trip(spark):
    rows = spark.createDataFrame([("vm", n, bytearray(struct.pack(">d", 5.5 + n)), bytearray(bytes([n] * 12)), json.dumps({"n": "z" * n}), 1 + n % 2) for n in range(40)], "agent_id string, counter long, clock_bits binary, nonce binary, payload string, mode int")
    made = frames.sealed(rows, PROTOCOL, MASTER, F.col("mode"))
    plain = {r["counter"]: bytes(r["frame"]) for r in made.collect()}
    assert all(plain[n] == plain_frame("vm", n, 5.5 + n, bytes([n] * 12), json.dumps({"n": "z" * n}).encode()) for n in range(1, 40, 2))
    # sent, so that sealing and opening are plans of their own
    sent = spark.createDataFrame([(r["counter"], r["payload"], r["frame"]) for r in made.collect()], "at long, text string, frame binary")
    back = frames.opened(sent, PROTOCOL, MASTER)
    assert back.filter("error is null and payload = text and counter = at and clock = at + 5.5").count() == 40
    other = frames.opened(sent.select("frame"), PROTOCOL, b"another secret")
    assert {r["error"] for r in other.collect()} == {"authentication"}


def test_work_grows_with_the_length_of_a_frame(spark):
    text = json.dumps({"vm_id": "vm", "x": "y" * 100_000}).encode()
    raw = [plain_frame("vm", n, 1000.0, bytes([n] * 12), text) for n in range(20)]
    began = time.monotonic()
    got = read(spark, raw)
    assert time.monotonic() - began < 60
    assert all(r["error"] is None and r["payload"] == text.decode() for r in got.values())

"""Sealed frames of agents, opened and made with Columns.

A frame, big-endian: magic (4 bytes), version, mode, length of the agent's name,
name, counter (8), clock (8, a double of Unix seconds), nonce (12), length of the
sealed part (4), sealed part, and a frame that is cut is malformed.  All before that length is
authenticated.  Mode 1 is
AES-256-GCM; mode 2 is a stream of HMAC-SHA256 blocks over nonce and block number,
with an HMAC-SHA256 of header and text behind it.  Keys are an agent's own, by
HKDF-SHA256 from the master secret.

Headers, keys, tests and mode 1 are Columns; the stream of mode 2 is hashed and
combined row by row in Arrow batches, so the work grows with a frame's length.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GCM, STREAM = 1, 2


@dataclass(frozen=True)
class Protocol:
    """What sender and receiver agree on."""

    magic: bytes
    info: bytes
    enc_salt: bytes
    mac_salt: bytes
    version: int = 2
    skew_s: float = 120.0


def _sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def _hmac(inner: Column, outer: Column, message: Column) -> Column:
    """inner, outer: the padded keys."""
    return _sha(F.concat(outer, _sha(F.concat(inner, message))))


def agent_key(master: bytes, salt: bytes, info: bytes, agent: Column) -> Column:
    """32 bytes for the agent; what does not depend on it is done here."""
    known = hmac.new(salt or b"\0" * 32, master, hashlib.sha256).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ p for b in known)) for p in (0x36, 0x5C))
    return _hmac(inner, outer, F.concat(F.lit(info), agent.cast("binary"), F.lit(b"\x01")))


def _number(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


def _combined(text: bytes, key: bytes, nonce: bytes) -> bytes:
    """The text combined, bit by bit, with as much of the key's stream."""
    blocks = b"".join(hmac.digest(key, nonce + i.to_bytes(4, "big"), "sha256") for i in range(-(-len(text) // 32)))
    return (int.from_bytes(text, "big") ^ int.from_bytes(blocks[: len(text)], "big")).to_bytes(len(text), "big")


def _with_streams(rows: DataFrame, work: Callable[..., bytes | None], out: str, body: str) -> DataFrame:
    """rows whose column out is work on keys, nonce, header and body, where there
    is a body; it ends a plan, so that what is read often is not written out again."""
    names = [body, "_enc", "_mac", "nonce", "_head", out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch.column(n).to_pylist() for n in names))
            made = [old if data is None else work(*given, data) for data, *given, old in columns]
            yield batch.set_column(batch.schema.get_field_index(out), out, pa.array(made, batch.schema.field(out).type))

    return rows.mapInArrow(run, rows.schema)


def _sealed(enc: bytes, mac: bytes, nonce: bytes, head: bytes, text: bytes) -> bytes:
    hidden = _combined(text, enc, nonce)
    return hidden + hmac.digest(mac, head + hidden, "sha256")


def _opened(enc: bytes, mac: bytes, nonce: bytes, head: bytes, body: bytes) -> bytes | None:
    hidden, tag = body[:-32], body[-32:]
    fine = len(body) >= 32 and hmac.compare_digest(hmac.digest(mac, head + hidden, "sha256"), tag)
    return _combined(hidden, enc, nonce) if fine else None


def _clock(bits: Column) -> Column:
    """The double of 8 bytes; null for negative ones."""
    number = F.conv(F.hex(bits), 16, 10).try_cast("long")
    power = F.shiftright(number, 52) - 1023
    part = number.bitwiseAND((1 << 52) - 1) / F.lit(float(1 << 52))
    return F.when(power < 1024, (1 + part) * F.pow(F.lit(2.0), power.cast("double")))


def opened(frames: DataFrame, protocol: Protocol, master: bytes, agents: list[str] | None = None, now: Column | None = None, frame: str = "frame") -> DataFrame:
    """frames with agent_id, counter, clock, nonce, payload (text) and error:
    null, or the first test that a frame fails: malformed, version, agent, skew,
    mode, authentication, payload, spoof.

    agents: names that are accepted, all if none; now: Unix seconds, to which a
    clock may differ by the skew.  An error leaves the payload null.
    """
    raw = F.col(frame)
    at = lambda start, size: F.substring(raw, start, size if isinstance(size, Column) else F.lit(size))
    number = lambda b: F.conv(F.hex(b), 16, 10).try_cast("long")
    size = F.coalesce(number(at(F.lit(7), 1)).cast("int"), F.lit(0))
    rows = frames.withColumns({"_id": at(F.lit(8), size), "_size": size})
    base = F.col("_size") + 8
    rows = rows.withColumns({
        "agent_id": F.when(F.is_valid_utf8(F.col("_id").cast("string")), F.col("_id").cast("string")), "counter": number(at(base, 8)), "clock": _clock(at(base + 8, 8)), "nonce": at(base + 16, 12),
        "_head": at(F.lit(1), base + 27), "_held": number(at(base + 28, 4)), "_mode": number(at(F.lit(6), 1)), "_version": number(at(F.lit(5), 1)),
    })
    rows = rows.withColumn("_sealed", at(F.col("_size") + 40, F.col("_held").cast("int")))
    # keys once a row, and no work where the header already fails
    whole = (at(F.lit(1), 4) == F.lit(protocol.magic)) & (F.octet_length(F.col("nonce")) == 12) & F.col("_held").isNotNull() & F.col("agent_id").isNotNull() & F.col("clock").isNotNull() & F.col("counter").isNotNull() & (F.octet_length("_sealed") == F.col("_held"))
    tests = [(~F.coalesce(whole, F.lit(False)), "malformed"), (F.col("_version") != protocol.version, "version")]
    if agents is not None:
        tests.append((~F.col("agent_id").isin(agents), "agent"))
    if now is not None:
        tests.append((F.abs(now - F.col("clock")) > protocol.skew_s, "skew"))
    tests.append((~F.col("_mode").isin(GCM, STREAM), "mode"))
    early = reduce(lambda out, t: F.when(t[0], t[1]).otherwise(out), reversed(tests), F.lit(None).cast("string"))
    rows = rows.withColumn("_early", early).withColumns({k: F.when(F.col("_early").isNull(), agent_key(master, salt, protocol.info, F.col("agent_id"))) for k, salt in (("_enc", protocol.enc_salt), ("_mac", protocol.mac_salt))})
    gcm = F.try_aes_decrypt(F.concat("nonce", "_sealed"), F.col("_enc"), F.lit("GCM"), F.lit("DEFAULT"), F.col("_head"))
    good = F.col("_early").isNull()
    rows = rows.withColumns({"_plain": F.when(good & (F.col("_mode") == GCM), gcm), "_stream": F.when(good & (F.col("_mode") == STREAM), F.col("_sealed"))})
    rows = _with_streams(rows.select(*frames.columns, "agent_id", "counter", "clock", "nonce", "_early", "_enc", "_mac", "_head", "_plain", "_stream"), _opened, "_plain", "_stream")
    rows = rows.withColumn("payload", F.col("_plain").cast("string"))
    claimed = F.get_json_object("payload", "$.vm_id")
    late = F.when(F.col("_plain").isNull(), "authentication").when(F.try_parse_json("payload").isNull(), "payload").when(claimed != F.col("agent_id"), "spoof")
    rows = rows.withColumn("error", F.coalesce("_early", late))
    return rows.select(*frames.columns, "agent_id", "counter", "clock", "nonce", F.when(F.col("error").isNull(), F.col("payload")).alias("payload"), "error")


def replays(frames: DataFrame, order: list[str]) -> DataFrame:
    """opened frames whose error also names replays: a nonce that the agent used
    before, or a counter not above all that it was accepted with; in the order
    in which frames came."""
    good = F.col("error").isNull()
    again = F.row_number().over(Window.partitionBy("agent_id", "nonce", good).orderBy(*order)) > 1
    rows = frames.withColumn("_again", again & good)
    before = Window.partitionBy("agent_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    most = F.max(F.when(good & ~F.col("_again"), F.col("counter"))).over(before)
    found = rows.withColumn("_most", most)
    told = F.when(F.col("_again"), "replay").when(good & (F.col("counter") <= F.col("_most")), "counter")
    return found.withColumn("error", F.coalesce("error", told)).withColumn("payload", F.when(F.col("error").isNull(), F.col("payload"))).drop("_again", "_most")


def sealed(rows: DataFrame, protocol: Protocol, master: bytes, mode: Column, clock: str = "clock_bits") -> DataFrame:
    """rows (agent_id, counter, clock_bits: 8 bytes of the clock's double, nonce,
    payload) with their ``frame``: what a sender makes."""
    name = F.col("agent_id").cast("binary")
    head = F.concat(F.lit(protocol.magic), F.lit(bytes([protocol.version])), _number(mode, 1), _number(F.octet_length(name), 1), name, _number(F.col("counter"), 8), F.col(clock), F.col("nonce"))
    made = rows.withColumns({"_head": head, "_text": F.col("payload").cast("binary"), "_enc": agent_key(master, protocol.enc_salt, protocol.info, F.col("agent_id")), "_mac": agent_key(master, protocol.mac_salt, protocol.info, F.col("agent_id"))})
    gcm = F.aes_encrypt(F.col("_text"), F.col("_enc"), F.lit("GCM"), F.lit("DEFAULT"), F.col("nonce"), F.col("_head"))
    # the cipher puts its nonce first, which the header has already
    gcm = F.substring(gcm, F.lit(13), F.octet_length(gcm))
    made = made.withColumns({"_body": F.when(mode == GCM, gcm), "_stream": F.when(mode == GCM, F.lit(None)).otherwise(F.col("_text"))}).drop("_text")
    made = _with_streams(made, _sealed, "_body", "_stream")
    return made.withColumn("frame", F.concat("_head", _number(F.octet_length("_body"), 4), F.col("_body"))).drop("_head", "_enc", "_mac", "_stream", "_body")

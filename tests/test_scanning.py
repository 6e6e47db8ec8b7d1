"""Rules by one automaton against each rule on its own; offsets, redaction,
distances, memory marks."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from arcwatch.functions import text
from arcwatch.operators import hosts, rules, scanning
from arcwatch.sources import packets

PIECES = ["Failed password for root from 9.8.7.6", "INVALID user bob from 1.2.3.4", "su: FAILED SU (x) to root by eve", "../", "nmap", "Onload =", "' or '", "union  SELECT", "/TMP/", '" 404 ', '" 200 12345678 ', "é", "İ", "wget x | bash", "ssh_", "\\Temp\\", "select", "from", "user=q", "sudo: authentication failure "]


def test_log_rules_match_their_patterns_one_by_one(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 6))) for _ in range(400)] + ["", None]
    got = {}
    for r in rules.log_rules(spark.createDataFrame(list(enumerate(lines)), "n int, line string")).collect():
        got[r["n"], r["rule"]] = (r["at"], r["ip"], r["user"], r["actor"], r["bytes"], r["severity"], r["score"])
    want = {}
    for n, line in enumerate(lines):
        for name, pattern, severity, _, score in rules.LOG_RULES:
            m = re.search(pattern, line or "", re.I | re.A)
            if m:
                g = m.groupdict()
                want[n, name] = (m.start(), *[g.get(c) for c in rules.CAPTURES], severity, score)
    assert got == want and len({k[1] for k in want}) >= 12


def found(raw: bytes, spec: dict) -> list[int]:
    """Offsets by trying every place."""
    forms = []
    if "hex" in spec:
        forms = [re.compile(b"".join(b"." if b == "??" else re.escape(bytes.fromhex(b)) for b in spec["hex"].split()), re.S)]
    elif "regex" in spec:
        return [m.start() for m in re.finditer(spec["regex"].encode(), raw, re.S | (re.I if spec.get("nocase") else 0))]
    else:
        plain = bytes(b ^ spec.get("xor", 0) for b in spec["text"].encode())
        forms = [re.compile(re.escape(plain), re.I if spec.get("nocase") else 0)]
        if spec.get("wide"):
            forms.append(re.compile(re.escape(spec["text"].encode("utf-16-le"))))
    at = sorted({i for i in range(len(raw)) for f in forms if f.match(raw, i)})
    word = lambda b: chr(b).isalnum() and b < 128 or b == 95
    if spec.get("fullword"):
        size = len(spec["text"].encode())
        at = [i for i in at if not (i and word(raw[i - 1])) and not (i + size < len(raw) and word(raw[i + size]))]
    return at


SPECS = {
    "plain": {"text": "aba"}, "nocase": {"text": "AbA", "nocase": True}, "wide": {"text": "ab", "wide": True}, "xor": {"text": "ab", "xor": 3}, "word": {"text": "ab", "fullword": True},
    "hex": {"hex": "61 62"}, "any": {"hex": "61 ?? 61"}, "regex": {"regex": "a+b", "nocase": True}, "same": {"text": "aba"}, "none": {"text": "zzz"},
}


def test_string_offsets_match_every_place(spark):
    rng = random.Random(7)
    data = [bytes(rng.choice(b"aabbAB\x00bc_ \xe9ba") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in enumerate(data)] + [(900, None)], "n int, data binary")
    got = {r["n"]: r["at"] for r in df.select("n", scanning.string_offsets(F.col("data"), SPECS).alias("at")).collect()}
    for n, raw in enumerate(data):
        assert got[n] == {name: at for name, spec in SPECS.items() if (at := found(raw, spec))}
    assert got[900] == {}


def test_scan_fires_as_the_rules_on_columns(spark):
    rng = random.Random(9)
    words = ["bitcoin ", "ONION ", ".locked", "sekurlsa::logonpasswords ", "kiwi", "lsadump::sam", "nc -e /bin/sh", "base64 -d ", "IEX(", "* * * * *", "wget ", "| bash", "nmap ", "SYN scan"]
    rows = [(n, "".join(rng.choice(words) for _ in range(3))) for n in range(200)]
    noise = bytes(rng.randrange(256) for _ in range(4000))
    df = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in rows] + [(500, bytearray(b"MZ" + noise + b"PE\0\0")), (501, bytearray(b"xMZ" + noise + b"PE\0\0")), (502, bytearray(b"MZPE\0\0")), (503, None)], "n int, data binary")
    scanned = rules.scan(df, rules.BYTE_RULES, F.col("data"))
    latin = df.withColumn("t", F.decode("data", "ISO-8859-1"))
    columns = rules.firing(latin, rules.BYTE_RULES, lambda r: rules.byte_rule(r, F.col("t")))
    told = {(r["n"], r["rule"]): r["offsets"] for r in scanned.collect()}
    assert set(told) == {(r["n"], r["rule"]) for r in columns.collect()} and (500, "packed_pe") in told and (501, "packed_pe") not in told
    assert told[500, "packed_pe"] == {"mz": [0], "pe": [4002]}
    placed = rules.scan(df, [{"title": "w", "level": "low", "strings": {"b": {"text": "PE", "within": (3, 9000)}}, "condition": "b"}], F.col("data"))
    assert {r["n"] for r in placed.collect()} >= {500, 501} and 502 not in {r["n"] for r in placed.collect()}


def test_secrets_of_any_length_are_not_shown_whole(spark):
    df = spark.createDataFrame([(s,) for s in ("pwd=abcd", "pwd=abcdefgh", "pwd=abcdefghi", "password=" + "x" * 70 + "yz12345", None)], "s string")
    assert [r["r"] for r in df.select(text.redact(F.col("s")).alias("r")).collect()] == ["pwd=***", "pwd=***", "pwd=abcd***fghi", "password***yz1234"[:11] + ("x" * 70 + "yz12345")[67:71], None]


def test_distance_is_that_of_swaps_once(spark):
    def plain(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if i == 0 or j == 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
    pairs = [(word(), word()) for _ in range(400)] + [("ca", "abc"), ("", ""), ("abcd", "")]
    rows = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").select(text.osa_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in rows] == [d if (d := plain(a, b)) <= 3 else 99 for a, b in pairs] + [None]
    assert plain("ca", "abc") == 3


def test_sleds_and_icmp_payloads(spark):
    df = spark.createDataFrame([(n, "[x]", "rw-", bytearray(b"a" + b"\x90" * n + b"b")) for n in (7, 15, 16, 40)], "pid int, region string, perms string, data binary")
    got = {(r["pid"], r["kind"], r["detail"]) for r in hosts.memory_findings(df).collect()}
    assert got == {(15, "malware", "nop_sled"), (16, "malware", "nop_sled"), (40, "malware", "nop_sled"), (16, "shellcode_pattern", "16"), (40, "shellcode_pattern", "40")}
    ip = bytes([0x45, 0, 0, 20 + 12, 0, 0, 0, 0, 64, 1, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8])
    assert packets.decode(b"\0" * 12 + b"\x08\x00" + ip + b"\x08\x00cs" + b"payload!")["payload"] == b"payload!"

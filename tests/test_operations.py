"""Payloads, rule text, files, sinks and hunts on small fixtures."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from arcwatch import sinks
from arcwatch.functions import binaries
from arcwatch.operators import audits, hunts, lifecycle, reports, rule_text, rules
from arcwatch.sources import payloads, snapshots


def name(*labels: str) -> bytes:
    return b"".join(bytes([len(x)]) + x.encode() for x in labels) + b"\0"


def question(number: int, qname: bytes, flags: int = 0x0100, count: int = 1) -> bytes:
    return struct.pack(">6H", number, flags, count, 0, 0, 0) + qname + struct.pack(">2H", 16, 1)


def client_hello(host: str) -> bytes:
    sni = struct.pack(">HBH", len(host) + 3, 0, len(host)) + host.encode()
    extensions = struct.pack(">2H", 23, 0) + struct.pack(">2H", 0, len(sni)) + sni
    body = b"\x03\x03" + bytes(32) + b"\x02ab" + struct.pack(">H", 2) + b"\x13\x01" + b"\x01\x00" + struct.pack(">H", len(extensions)) + extensions
    hello = b"\x01" + struct.pack(">I", len(body))[1:] + body
    return b"\x16\x03\x01" + struct.pack(">H", len(hello)) + hello


def test_dns_messages():
    assert payloads.dns_message(question(7, name("www", "x", "org"))) == (7, False, [("www.x.org", 16)])
    pointed = question(8, name("x", "org"), 0x8180, 2) + b"\x03abc\xc0\x0c" + struct.pack(">2H", 1, 1)
    assert payloads.dns_message(pointed) == (8, True, [("x.org", 16), ("abc.x.org", 1)])
    assert payloads.dns_message(b"short") is None and payloads.dns_message(None) is None
    loop = struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c"
    assert payloads.dns_message(loop)[2] == []


def test_client_hellos():
    assert payloads.server_name(client_hello("a.example.org")) == "a.example.org"
    assert payloads.server_name(client_hello("a.example.org")[:-4]) is None
    assert payloads.server_name(b"\x17\x03\x01\x00\x01x") is None and payloads.server_name(None) is None


def test_payload_columns(spark):
    http = b"GET /a?b=1 HTTP/1.1\r\nHost: Web.org\r\nUser-Agent: x y\r\n\r\nbody"
    rows = [
        (1, "10.0.0.1", 1, "udp", 53, bytearray(question(1, name("a1b2c3d4e5f6g7h8i9j0k1l2m3n4", "t", "org")))), (2, "10.0.0.1", 2, "udp", 53, bytearray(question(1, name("a1b2c3d4e5f6g7h8i9j0k1l2m3n4", "t", "org")))),
        (3, "10.0.0.1", 3, "udp", 53, bytearray(question(1, name("www", "org")))), (4, "10.0.0.2", 4, "tcp", 80, bytearray(http)), (5, "10.0.0.2", 5, "tcp", 443, bytearray(client_hello("h.org"))), (6, "10.0.0.2", 6, "tcp", 80, bytearray(b"HTTP/1.1 404 Not Found\r\n")),
        (7, "10.0.0.2", 7, "udp", 53, None),
    ]
    packets = spark.createDataFrame(rows, "us long, src_ip string, frame_no long, transport string, dst_port int, payload binary")
    found = payloads.tunnelled_names(payloads.dns_queries(packets)).collect()
    assert [(r["src_ip"], r["us"], r["label"]) for r in found] == [("10.0.0.1", 1, "a1b2c3d4e5f6g7h8i9j0k1l2m3n4")]
    read = {r["us"]: r for r in packets.select("us", payloads.http(F.col("payload")).alias("h"), payloads.sni("payload").alias("s")).collect()}
    assert (read[4]["h"]["method"], read[4]["h"]["uri"], read[4]["h"]["host"], read[4]["h"]["user_agent"]) == ("GET", "/a?b=1", "Web.org", "x y")
    assert (read[6]["h"]["type"], read[6]["h"]["status"], read[6]["h"]["reason"]) == ("response", 404, "Not Found")
    assert read[5]["s"] == "h.org" and read[5]["h"] is None and read[7]["h"] is None and read[4]["s"] is None


RULES = """
// a comment with rule fake {
rule marks : one two {
  meta:
    severity = "high"
    mitre = "T1059"
  strings:
    $a = "Evil \\"x\\"" nocase
    $w = "wide" wide
    $x = "secret" xor(5a)
    $f = "cat" fullword
    $h = { 4D 5A ?? 90 }
    $r = /ab+c/ nocase
  condition:
    $a or ($w and not $f) or $x or (2 of ($h, $r)) or $h at 0
}
rule sized { strings: $b = "b}" condition: $b and filesize < 1KB and entropy(0, filesize) < 3 }
rule placed { strings: $c = "cc" condition: $c in (2..4) }
rule all_of { strings: $s1 = "one" $s2 = "two" condition: all of ($s*) }
"""


def test_rule_text(spark):
    parsed = rule_text.parse(RULES.replace("(2 of ($h, $r))", "$r"))
    assert [r["title"] for r in parsed] == ["marks", "sized", "placed", "all_of"]
    assert parsed[0]["tags"] == ["one", "two"] and parsed[0]["level"] == "high" and parsed[0]["strings"]["x"] == {"xor": 0x5A, "text": "secret"}
    data = {
        "nocase": b'an eVIL "X" here', "wide": "wide".encode("utf-16-le"), "xor": bytes(b ^ 0x5A for b in b"secret"), "word": b"wide cat", "part": b"wide concat", "hex": b"MZ\x01\x90", "late": b"-MZ\x01\x90",
        "regex": b"xABBC", "brace": b"b}bbbb", "long": b"b}" + b"q" * 2000, "in": b"--cc", "out": b"------cc", "both": b"two one", "one": b"one",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "id string, data binary").withColumn("t", F.decode("data", "ISO-8859-1"))
    fired = rules.firing(df, parsed, lambda r: rule_text.compile_rule(r, F.col("t")))
    assert sorted((r["id"], r["rule"]) for r in fired.collect()) == [("both", "all_of"), ("brace", "sized"), ("hex", "marks"), ("in", "placed"), ("nocase", "marks"), ("part", "marks"), ("regex", "marks"), ("wide", "marks"), ("xor", "marks")]


def test_rule_folders_and_bad_patterns(spark, tmp_path):
    (tmp_path / "b.vyr").write_text('rule b { strings: $x = "x" condition: $x }')
    (tmp_path / "a.vyr").write_text('rule a { strings: $x = "x" condition: $x }')
    assert [r["title"] for r in rule_text.load(str(tmp_path))] == ["a", "b"]
    (tmp_path / "r.yml").write_text("title: t\ndetection:\n  sel:\n    a|re: '['\n  condition: sel\n")
    (tmp_path / "n.yml").write_text("title: no detection\n")
    loaded = pytest.importorskip("yaml") and rules.load_sigma(str(tmp_path))
    assert [r["title"] for r in loaded] == ["t"]
    df = spark.createDataFrame([("[",)], "a string")
    assert df.filter(rules.sigma(loaded[0], F.col)).count() == 0  # no regular expression, no match


def test_files_are_scanned_without_the_excluded(spark, tmp_path):
    for f, content in {"keep.txt": b"abc", "a.log": b"x", "big.bin": b"y" * 50}.items():
        (tmp_path / f).write_bytes(content)
    got = {r["path"].split("/")[-1]: r for r in snapshots.scan_files(spark, str(tmp_path), most_bytes=10).collect()}
    assert got.keys() == {"keep.txt", "big.bin"}
    assert got["keep.txt"]["sha256"].startswith("ba7816bf") and got["big.bin"]["sha256"] is None and got["big.bin"]["size"] == 50


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "high", "a|b"), (2, "low", None)], "id int, severity string, text string")
    sinks.write_findings(df, str(tmp_path / "out"), "medium")
    assert [r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()] == [1]
    sinks.save_baseline(df, str(tmp_path / "base"), b"key")
    assert sinks.load_baseline(spark, str(tmp_path / "base"), b"key").count() == 2
    with pytest.raises(ValueError, match="changed"):
        sinks.load_baseline(spark, str(tmp_path / "base"), b"other")
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "base" / "rows"))
    with pytest.raises(ValueError, match="changed"):
        sinks.load_baseline(spark, str(tmp_path / "base"), b"key")
    text = sinks.markdown("Report", {"Findings": df.orderBy("id")}, shown=1)
    assert text.splitlines()[0] == "# Report" and "| 1 | high | a\\|b |" in text and "| 2 |" not in text
    merged = sinks.merge_baseline(df.select("severity", F.lit(1).alias("n")), df.select("severity", F.lit(2).alias("n")), ["severity"], ["n"])
    assert {(r["severity"], r["n"]) for r in merged.collect()} == {("high", 3), ("low", 3)}


def test_baselines_of_hosts_and_indicators(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"ip": "1.1.1.1", "mac": "aa", "vendor": "v"}]))
    assert [(r["ip"], r["mac"]) for r in snapshots.host_baseline(spark, str(tmp_path / "b.json")).collect()] == [("1.1.1.1", "aa")]
    assert snapshots.known_indicators(spark).count() == 11


def test_credential_hunt(spark):
    rows = [(1, "Mimikatz.exe", "", ""), (2, "certutil.exe", "certutil -urlcache x", ""), (3, "powershell.exe", "p -Enc AA", ""), (4, "taskmgr.exe", "dump LSASS", ""), (5, "bash", "", "")]
    df = spark.createDataFrame(rows, "pid int, name string, cmdline string, exe string")
    assert {r["pid"]: r["match"] for r in hunts.credential_tools(df).collect()} == {1: "tool_name", 2: "certutil_download", 3: "powershell_encoded", 4: "lsass_access"}
    chains = spark.createDataFrame([(1, "CertUtil.exe", "x -SPLIT y"), (2, "mshta", "mshta http://x"), (3, "rundll32.exe", "plain"), (4, "curl", "-urlcache")], "pid int, name string, cmdline string")
    assert sorted(r["pid"] for r in hunts.downloaders(chains).collect()) == [1, 2]


def test_odd_connections(spark):
    rows = [("nc", "ESTABLISHED", "9.9.9.9", 4444), ("nc", "ESTABLISHED", "10.0.0.1", 4444), ("nc", "LISTEN", "9.9.9.9", 4444), ("nc", "ESTABLISHED", "9.9.9.9", 443), ("Chrome", "ESTABLISHED", "9.9.9.9", 4444), (None, "ESTABLISHED", "9.9.9.9", 31337)]
    df = spark.createDataFrame(rows, "process string, status string, remote_ip string, remote_port int")
    assert sorted(r["remote_port"] for r in hunts.odd_connections(df).collect()) == [4444, 31337]


def test_verdicts_come_in_order(spark):
    df = spark.createDataFrame([("EXEC-03", 1, 0, 0), ("CRED-01", 1, 0, 0), ("C2-01", None, 0, 0), ("EVAD-01", 0, 0, 0)], "hunt string, n_hits int, n_logs int, n_other int")
    got = hunts.verdicts(df).orderBy(*hunts.verdict_order()).collect()
    assert [(r["hunt"], r["status"], r["score"]) for r in got] == [("CRED-01", "CONFIRMED", 108), ("EXEC-03", "SUSPECT", 18), ("C2-01", "INSUFFICIENT_DATA", 0), ("EVAD-01", "NEGATIVE", 0)]
    out = df.limit(1).select(hunts.file_verdict(F.lit("a"), F.lit("b"), F.lit(7.5), ["a"]).alias("x"), hunts.file_verdict(F.lit("c"), F.lit("d"), F.lit(7.5), ["a"]).alias("y"), hunts.file_verdict(F.lit("c"), F.lit("d"), F.lit(3.0), ["a"]).alias("z")).first()
    assert tuple(out) == ("MALICIOUS", "SUSPICIOUS", "CLEAN")


def test_packed_files(spark):
    import os

    rows = [("/usr/bin/a", 5000, bytearray(b"\x7fELF" + os.urandom(5000))), ("/usr/bin/b", 5000, bytearray(b"MZ" + b"a" * 5000)), ("/usr/bin/c", 0, bytearray())]
    df = spark.createDataFrame(rows, "path string, size long, data binary").selectExpr("*", "493 as mode", "0 as mtime", "0 as ctime")
    assert [(r["path"], r["finding"]) for r in hunts.file_findings(df).collect()] == [("/usr/bin/a", "packed_binary")]


def test_empty_tables_give_defined_rows(spark):
    none = spark.createDataFrame([], "status string, latency_ms double, severity string, fingerprint string, entity string, hit_count long, score int, tool string, tactic string, us long")
    assert tuple(lifecycle.alert_measures(none).first()) == (0, 0, 0, 0, 0, 0, 0, 0.0, 0.0)
    assert reports.risk_summary(none).first()["risk"] == 0
    assert reports.trend(none, none).first()["trend"] == "STABLE"
    hosts = spark.createDataFrame([("h",)], "host string")
    users = spark.createDataFrame([], "host string, name string, uid int, shell string, home_mode int, password string")
    assert audits.accounts(hosts, users).count() == 0


def test_orders_and_retention(spark):
    ips = spark.createDataFrame([("10.0.0.10",), ("9.0.0.1",), ("10.0.0.9",)], "ip string")
    assert [r["ip"] for r in ips.orderBy(reports.address_order()).collect()] == ["9.0.0.1", "10.0.0.9", "10.0.0.10"]
    found = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "fingerprint string, us long")
    assert {r["fingerprint"] for r in reports.retained(found, 2).collect()} == {"b", "c"}
    events = snapshots.alert_events(spark.createDataFrame([("x", 2, "high", "e", 5, ""), ("y", 1, "low", "e", 5, "T1059")], "finding_type string, us long, severity string, entity string, score int, mitre string"))
    assert [(r["us"], r["mitre"]) for r in events.orderBy(*snapshots.chronological()).collect()] == [(1, "T1059"), (2, "T1486")]


def test_needed_texts_lose_no_log_line(spark):
    """Each rule with and without its needed texts, on lines that it matches."""
    lines = [
        "Failed password for x from 1.2.3.4", "Invalid user Bob from 1.2.3.4", "sudo: pam authentication failure; user=bob", "su: FAILED SU (to root) to root by bob", "Account Locked", "TOO MANY AUTH", "pam_tally2 user locked", "Accepted publickey for root from 1.2.3.4",
        "Accepted password for al from 1.2.3.4", "UNION  SELECT 1", "select a from b", "or  1=1", "' or '", "INFORMATION_SCHEMA", "<SCRIPT >", "JavaScript:x", "onError = 1", "onmouseover=2", "../x", "..\\x", "%2E%2e%2f", "%252e%252E", "/etc/passwd", "CMD.exe", "eval(", "NIKTO", "wfuzz",
        '" 404 ', "CronTab", "cron.d", "at.deny", "systemctl now enable", "x.service was created", "AUTHORIZED_KEYS", "/.ssh/", "useradd", "net user bob /add", "New user", "User added", "usermod", "net localgroup", '" 200 12345678 ', "FromBase64", "b64decode", "ToBase64", "/TMP/", "/var/tmp/", "c:\\Temp\\x",
        "C:\\AppData\\Local\\Temp\\x", "wget x | bash", "CURL y |  python", "nc -e", "bash -i", "python -c socket", "socat tcp exec", "plain",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {(r["line"], r["rule"]) for r in rules.log_rules(df).collect()}
    plain = rules.firing(df, [{"title": n, "p": p.replace("(?P<", "(?<")} for n, p, *_ in rules.LOG_RULES], lambda r: F.col("line").rlike(f"(?i){r['p']}"), facts=())
    assert got == {(r["line"], r["rule"]) for r in plain.select("line", "rule").collect()}
    assert {r for _, r in got} == {n for n, *_ in rules.LOG_RULES}


def program(sections: list[tuple[bytes, bytes]]) -> bytes:
    """A PE program of so many sections, its header at 64."""
    head = bytearray(b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HH", 0x14C, len(sections)) + bytes(12) + struct.pack("<HH", 0, 0))
    body, start = b"", 64 + 24 + 40 * len(sections)
    for title, content in sections:
        head += title.ljust(8, b"\0") + bytes(8) + struct.pack("<2I", len(content), start + len(body)) + bytes(16)
        body += content
    return bytes(head) + body


def test_binaries(spark):
    import hashlib

    exe = program([(b".text", bytes(range(256))), (b".data", b"\1" * 64)])
    region = b"xMZ" + b"junk" * 30 + exe + b"\x7fELF.." + b"MZ"
    df = spark.createDataFrame([(1, bytearray(exe)), (2, bytearray(region)), (3, None), (4, bytearray(b""))], "id int, data binary")
    got = {r["id"]: r for r in df.select("id", binaries.blake2b("data").alias("h"), binaries.programs("data").alias("p"), binaries.sections("data").alias("s")).collect()}
    assert got[1]["h"] == hashlib.blake2b(exe, digest_size=32).hexdigest() and got[3]["h"] is None and got[3]["p"] is None
    assert [tuple(p) for p in got[1]["p"]] == [("PE", 0)]
    assert [tuple(p) for p in got[2]["p"]] == [("PE", 123), ("ELF", 123 + len(exe))]
    assert [(s["name"], round(s["entropy"], 6)) for s in got[1]["s"]] == [(".text", 8.0), (".data", 0.0)] and got[2]["s"] == [] and got[4]["s"] == []

